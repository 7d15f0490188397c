import os

import duckdb
import pytest

import __spark_entry__ as contract
from locusflow.plans.oracle import ORACLE_SQL
from locusflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
CHEAP = [n for n in QUERIES if n not in ("ld_pairwise", "ld_matrix", "ld_max_dist", "ld_per_pop_min_dist", "ld_per_pop_sampled")]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{DATA}/{name}')")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple(repr(float(r[k])) if isinstance(r[k], float) else str(r[k]) for k in at) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared test tables")
@pytest.mark.parametrize("name", CHEAP)
def test_same_as_sql(spark, db, name):
    frame = QUERIES[name](spark, DATA)
    found, columns = [tuple(r) for r in frame.collect()], frame.columns
    assert found
    if name in ORACLE_SQL:
        cursor = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(columns)
        assert plain(found, columns, sorted(columns)) == plain(cursor.fetchall(), names, sorted(columns))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared test tables")
@pytest.mark.parametrize("name", ["vcf_scan", "vcf_bgzip_scan"])
def test_places_do_not_depend_on_files(spark, tmp_path, name):
    """Spark reads the largest file first: the table's rows don't come by vec_id."""
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    for low, high in ((0, 40), (40, 390), (390, 500)):
        table.where(f"vec_id >= {low} and vec_id < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "embeddings.parquet"))
    found = [(r.var_id, r.id) for r in QUERIES[name](spark, str(tmp_path)).orderBy("var_id").collect()]
    assert found == [(i, f"v{i}") for i in range(500)]


def test_contract(spark):
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1
