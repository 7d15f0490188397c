import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from locusflow import scratch
from locusflow.frame import VariantFrame
from locusflow.functions import genotypes as G
from locusflow.operators import blocks, dists, filters, ld, ordination, stats
from locusflow.operators.pipeline import Pipeline
from locusflow.plans import queries as genetics_queries

M = [-1, -1]


def frame(spark, gts, **kwargs):
    return VariantFrame.from_gt_array(spark, np.array(gts), **kwargs)


def by_var(df, column, pop=None):
    rows = df.where(F.col("pop") == pop) if pop else df
    return [r[column] for r in rows.orderBy("var_id").collect()]


def close(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (found, wanted)


# Golden genotypes and, in the tests, the results asserted of them and of seeded draws (FIXTURES.md).
HET = [[[0, 0], [1, 1], M, [0, 1]], [[-1, 1], [0, 0], [0, 1], [1, 0]], [M] * 4]
MISSING = [[[0, 0], [2, 1], [0, 0], [0, 0], [0, 0]], [[0, 0], [0, 0], [0, 1], [1, 0], M], [M] * 5]
MAF = [[[0, 0], [2, 1], [0, 0], [0, 0], [0, 0]], [[0, 0], [0, 0], [0, 1], [1, 0], [1, 1]], [[1, 1]] * 5]


def test_missing_and_het(spark):
    rows = stats.genotype_flags(frame(spark, HET)).orderBy("var_id", "sample_idx").collect()
    assert "".join("FT"[r.is_missing] for r in rows) == "FFTFTFFFTTTT"
    assert "".join("FT"[r.is_het] for r in rows) == "FFFTFFTTFFFF"
    found = stats.calc_obs_het_stats_per_var(frame(spark, HET), hist_kwargs={"num_bins": 4})
    assert abs(found["mean"].first()["mean"] - 0.5) < 1e-9
    assert [r.n for r in found["hist"].orderBy("bin").collect()] == [0, 1, 1, 0]


def test_allele_counts(spark):
    gts = [HET[0], [[-1, 1], [0, 4], [0, 1], [1, 3]], HET[2]]
    freqs = stats.allele_freqs_per_var(frame(spark, gts), min_num_samples=1)
    rows = {(r.var_id, r.allele): (r.n, r.freq, r.missing_alleles) for r in freqs.collect()}
    assert rows[0, 0][0] == 3 and rows[0, 1][0] == 3 and rows[0, 0][2] == 2
    assert [rows[1, a][0] for a in (0, 1, 3, 4)] == [2, 3, 1, 1]
    close([rows[1, a][1] for a in (0, 1, 3, 4)], [2 / 7, 3 / 7, 1 / 7, 1 / 7])
    strict = stats.allele_freqs_per_var(frame(spark, gts), min_num_samples=3.1)
    assert all(r.freq is None for r in strict.where("var_id = 0").collect())
    summary = G.pop_summaries(frame(spark, gts)).orderBy("var_id").collect()
    assert [r.missing_alleles for r in summary] == [2, 1, 8]


def test_major_freq(spark):
    gts = [HET[0], [[-1, 1], [1, 0], [0, 1], [1, 0]], HET[2]]
    close(by_var(stats.major_freq_per_var(frame(spark, gts), min_num_samples=1), "major_freq"), [0.5, 0.57142857, None])
    found = stats.calc_major_allele_stats_per_var(frame(spark, gts), min_num_samples=1, hist_kwargs={"num_bins": 4})
    assert abs(found["mean"].first()["mean"] - 0.535714) < 1e-6
    assert [r.n for r in found["hist"].orderBy("bin").collect()] == [0, 0, 2, 0]


def test_pops_and_poly(spark):
    np.random.seed(42)
    held = frame(spark, np.random.randint(-1, 3, (3, 10, 2)))
    pops = {"a": [0, 1, 2, 3, 4], "b": [5, 6, 7, 8, 9]}
    freqs = stats.major_freq_per_var(held, pops, 3)
    close(by_var(freqs, "major_freq", "a"), [0.57142857, 0.55555556, 0.4])
    close(by_var(freqs, "major_freq", "b"), [0.55555556, None, 0.5])
    rows = {r["pop"]: r for r in stats.calc_poly_vars_ratio_per_var(held, 0.51, pops, 3).collect()}
    assert [rows[p].num_variable for p in "ab"] == [3, 2] and [rows[p].num_poly for p in "ab"] == [1, 1]
    close([rows[p].poly_ratio for p in "ab"], [1 / 3, 0.5])
    over = stats.calc_major_allele_stats_per_var(held, {"a": [0, 1, 2, 3, 4], "c": [4, 5, 6, 7, 8, 9]}, 3, {"num_bins": 20})["hist"]
    assert {r.bin: r.n for r in over.where("pop = 'a' and n > 0").collect()} == {8: 1, 11: 2}
    with pytest.raises(KeyError):
        held.pop_indexes({"x": ["nobody"]})


def test_expected_het(spark):
    gts = [[[0, 0], [2, 1], [0, 0], [0, 0], [0, -1]], [[0, 0], [0, 0], [0, 1], [1, 0], M], [M] * 5]
    pops = {"1": [0, 1], "2": [2, 3, 4]}
    raw = stats.exp_het_per_var(frame(spark, gts), pops, 1, unbiased=False)
    close(by_var(raw, "exp_het", "1"), [0.625, 0, None])
    close(by_var(raw, "exp_het", "2"), [0, 0.5, None])
    unbiased = stats.exp_het_per_var(frame(spark, gts), pops, 1)
    close(by_var(unbiased, "exp_het", "1"), [0.83333333, 0, None])
    close(by_var(unbiased, "exp_het", "2"), [0, 0.66666667, None])
    found = stats.calc_exp_het_stats_per_var(frame(spark, gts), None, 1, hist_kwargs={"num_bins": 4})
    assert abs(found["mean"].first()["mean"] - 0.422619) < 1e-6
    assert [r.n for r in found["hist"].orderBy("bin").collect()] == [0, 2, 0, 0]


def test_histogram_edges():
    assert stats.histogram_edges(40)[12] == np.linspace(0, 1, 41)[12]
    close(stats.histogram_edges(2, (1, 3), "logarithmic"), [10, 100, 1000])
    for bad in ({"bin_type": "logarithmic"}, {"bin_type": "other"}):
        with pytest.raises(ValueError):
            stats.histogram_edges(**bad)


def kept(variants):
    return [r.var_id for r in variants.df.orderBy("var_id").collect()]


def test_filters(spark):
    missing = frame(spark, MISSING)
    for limit, wanted in ((0, [0]), (0.5, [0, 1]), (-0.1, [])):
        assert kept(filters.filter_by_missing_data(missing, limit)) == wanted
    maf = frame(spark, MAF)
    assert kept(filters.filter_by_maf(maf, 0.9)) == [0, 1]
    some = filters.filter_by_maf(maf, 0.7)
    assert kept(some) == [1]
    assert [tuple(r) for r in filters.gather_filtering_stats(some).collect()] == [("maf", 3, 1)]
    for limit, wanted in ((0.3, [0, 2]), (0, [2]), (0.8, [0, 1, 2])):
        assert kept(filters.filter_by_obs_het(maf, limit)) == wanted
    for chosen in ([0, 1, 2], slice(3), [2, 1, 0, 99]):
        held = filters.filter_samples(maf, chosen)
        assert held.samples == (0, 1, 2)
        assert held.df.orderBy("var_id").first().gts == [0, 0, 2, 1, 0, 0]
    with pytest.raises(ValueError):
        filters.filter_samples(maf, ["nobody"])


A = [[0, 0], [2, 1], [0, 0], [0, 0], [0, 0]]
B = [[[0, 1], [1, 0], [2, 2], [1, 0], [0, 0]], [[1, 1], [2, 2], [0, 1], [0, 0], [1, 2]]]
C = [[[0, 1], [0, 0], [2, 0], [1, 0], [0, 0]], [[1, 0], [0, 2], [0, 1], [0, 0], [2, 2]]]


@pytest.mark.parametrize(("gts", "wanted"), [([[[1, 1]] * 5] * 3, []), ([A, *B], [0, 1, 2]), ([A, A, C[0], C[1], C[1]], [0, 3]), (MAF, [0]), ([A, A, A], [0])])
def test_ld_filter(spark, gts, wanted):
    held = frame(spark, gts)
    assert kept(filters.filter_by_ld_and_maf(held.with_df(held.df.repartition(3)), 0.1, 0.9)) == wanted


@pytest.mark.parametrize("chunk_size", [1, 3, 7])
def test_ld_filter_in_stretches(spark, chunk_size):
    rng = np.random.default_rng(6)
    sparse = np.repeat(rng.integers(0, 2, (8, 12, 2)), 4, axis=0)  # copies: whole stretches keep nothing
    held = frame(spark, np.concatenate([sparse, rng.integers(0, 2, (10, 12, 2))]))
    held = held.with_df(held.df.where("var_id not in (5, 6)"))
    coded = {r.var_id: r.coded for r in ld.coded_variants(held).collect()}
    last, wanted = None, []
    for i in sorted(coded):
        r = None if last is None else filters.signed_r(np.array(coded[last]), np.array(coded[i]))
        if last is None or r is not None and abs(r) < 0.3:
            last = i
            wanted.append(i)
    assert 2 < len(wanted) < len(coded) and kept(filters.filter_by_ld_and_maf(held, 0.3, 1.0, chunk_size=chunk_size)) == wanted


def test_ld_filter_by_chrom(spark):
    held = frame(spark, [A, A, A, A], vars_info={"chrom": ["1", "1", "2", "2"], "pos": [1, 2, 1, 2]})
    assert kept(filters.filter_by_ld_and_maf(held, 0.1, 0.95, by_chrom=True)) == [0, 2]


def test_per_sample(spark):
    rows = stats.calc_per_sample_stats(frame(spark, MISSING)).orderBy("sample_idx").collect()
    close([r.missing_gt_rate for r in rows], [1 / 3] * 4 + [2 / 3])
    close([r.obs_het_rate for r in rows], [0, 1 / 3, 1 / 3, 1 / 3, 0])


def test_012(spark):
    coded = ld.coded_variants(frame(spark, [[[0, -1], [0, 0], [0, 0], [0, 0], [0, 1], [1, 0], [1, 1]]])).first().coded
    assert coded == [-1, 0, 0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        ordination.create_012_gt_matrix(frame(spark, [[M, M]]))
    with pytest.raises(ValueError):
        ordination.create_012_gt_matrix(frame(spark, [[[0, 1], [2, 0]]]))


def test_kosman(spark):
    a = [M, [0, 0], [0, 1], [0, 0], [0, 0], [0, 1], [0, 1], [0, 1], [0, 0], [0, 0], [0, 1]]
    b = [[1, 1], M, [0, 0], [0, 0], [1, 1], [0, 1], [1, 0], [1, 0], [1, 0], [0, 1], [1, 1]]
    gts = np.stack([np.array(a), np.array(b), np.ones((11, 2), int), np.ones((11, 2), int)], axis=1)
    held = frame(spark, gts)
    close(dists.calc_pairwise_kosman_dists(held).dist_vector().tolist(), [1 / 3, 0.75, 0.75, 0.45, 0.45, 0])
    some = dists.calc_pairwise_kosman_dists(held, min_num_snps=10).df.orderBy("i", "j").collect()
    assert some[0].dist is None and some[1].dist is not None
    with pytest.raises(ValueError):
        dists.kosman_sums(held, [0])
    with pytest.raises(ValueError):
        dists.kosman_sums(frame(spark, np.zeros((2, 2, 3), int)))


def test_kosman_embedding(spark):
    rng = np.random.default_rng(3)
    groups = rng.random((4, 60))
    gts = np.stack([(rng.random((60, 2)) < groups[i % 4][:, None]).astype(int) for i in range(20)], axis=1)
    held = frame(spark, gts)
    exact = dists.calc_pairwise_kosman_dists(held).dist_vector()
    near = dists.calc_pairwise_kosman_dists(held, use_approx_embedding_algorithm=True).dist_vector()
    assert np.corrcoef(exact, near)[0, 1] > 0.9


def test_euclid_and_forms(spark):
    np.random.seed(42)
    data = pd.DataFrame(np.random.uniform(size=(4, 10)))
    found = dists.calc_euclidean_pairwise_dists(spark, data)
    close(found.dist_vector().tolist(), [0.8160523, 1.4245896, 1.74402628, 1.37436733, 1.84068677, 1.00002389])
    square = pd.DataFrame([[0, 0.5, 0.75], [0.5, 0, 0.3], [0.75, 0.3, 0]])
    held = dists.Distances.from_square(spark, square)
    assert held.dist_vector().tolist() == [0.5, 0.75, 0.3]
    assert np.allclose(held.square_dists(), square)
    assert held.triang_list_of_lists() == [[0.0], [0.5, 0.0], [0.75, 0.3, 0.0]]
    with pytest.raises(ValueError):
        dists.Distances.from_vector(spark, [0.5, 0.75, 0.3], ["a"])


def test_euclidean_blocks(spark):
    """Blocks meet without copies of their rows; null vectors have pairs of no distance."""
    values = np.random.default_rng(3).normal(size=(41, 6))
    rows = spark.createDataFrame([(k, None if k == 7 else v.tolist()) for k, v in enumerate(values)], "id long, features array<double>")
    found = dists.euclidean_pairs(rows, block=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    held = {(r.i, r.j): r.dist for r in found.collect()}
    assert len(held) == found.count() == 41 * 40 / 2 and all(i < j for i, j in held)
    for (i, j), dist in held.items():
        assert dist is None if 7 in (i, j) else abs(dist - np.linalg.norm(values[i] - values[j])) < 1e-12
    with pytest.raises(Exception, match="different lengths"):
        dists.euclidean_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "id int, features array<double>")).collect()


def bytes_a_row(frame, path):
    """What each row takes on disk as Spark writes it."""
    frame.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / frame.sparkSession.read.parquet(str(path)).count()


@pytest.mark.parametrize("values", [[], [2.5], [0.5, np.nan, 0.25, 0.0, 0.5, np.inf], np.random.default_rng(0).random(150_000)])
def test_places_by_value(values):
    """Each place once, the least value first, NaN last."""
    held = np.array(values, float)
    cuts = list(blocks.by_value(held))
    places = np.concatenate([*cuts, np.zeros(0, np.int64)])
    assert sorted(places.tolist()) == list(range(len(held))) and all(len(c) <= blocks.PAIRS for c in cuts)
    assert np.array_equal(np.round(held[places], 6), np.round(np.sort(held), 6), equal_nan=True)


def test_written_distances_take_little_disk(spark, tmp_path):
    """Pairs of two blocks come by distance, so that equal ones stand together when they are written."""
    v = np.random.default_rng(8).normal(size=(2_000, 16))
    rows = spark.createDataFrame([(k, (x / np.linalg.norm(x)).tolist()) for k, x in enumerate(v)], "id long, features array<double>")
    found = dists.euclidean_pairs(rows, block=2_000).withColumn("dist", F.round("dist", 5))
    assert bytes_a_row(found, tmp_path / "pairs") < 5
    assert found.count() == 2_000 * 1_999 / 2


def test_dest_is_symmetric_and_null_when_few(spark):
    rng = np.random.default_rng(1)
    held = frame(spark, rng.integers(0, 3, (4, 12, 2)))
    one = dists.jost_dest(held, {"a": list(range(6)), "b": list(range(6, 12))}, 1).first()
    two = dists.jost_dest(held, {"b": list(range(6)), "a": list(range(6, 12))}, 1).first()
    assert abs(one.dest - two.dest) < 1e-12 and one.n_vars == 4
    assert dists.calc_jost_dest_pop_dists(held, {"a": list(range(6)), "b": list(range(6, 12))}, min_num_samples=7).df.first().dist is None


def numpy_r(x, y):
    return np.corrcoef(x, y)[0, 1]


def test_ld_pairs(spark):
    rng = np.random.default_rng(5)
    gts = rng.integers(0, 2, (5, 9, 2))
    info = {"chrom": ["1", "1", "2", "2", "2"], "pos": [10, 20, 30, 40, 50]}
    held = frame(spark, gts, vars_info=info)
    pairs = ld.calc_pairwise_rogers_huff_r2(held, check_no_mafs_above=None, block=2).orderBy("var_id1", "var_id2").collect()
    assert [(r.var_id1, r.var_id2) for r in pairs] == [(i, j) for i in range(5) for j in range(i + 1, 5)]
    assert sorted(r.dist_in_bp for r in pairs if r.dist_in_bp is not None) == [10, 10, 10, 20]
    coded = {r.var_id: r.coded for r in ld.coded_variants(held).collect()}
    close([r.r2 for r in pairs], [numpy_r(coded[r.var_id1], coded[r.var_id2]) for r in pairs])
    near = ld.calc_pairwise_rogers_huff_r2(held, max_dist=15, check_no_mafs_above=None, block=1).collect()
    assert sorted(r.dist_in_bp for r in near) == [10, 10, 10] and len({(r.var_id1, r.var_id2) for r in near}) == 3
    matrix = ld.calc_rogers_huff_r2_matrix(held, check_no_mafs_above=None).collect()
    assert len(matrix) == 25 and all(r.r2 == 1 for r in matrix if r.var_id1 == r.var_id2)


def test_ld_refuses_major_alleles(spark):
    rare = frame(spark, [[[0, 0]] * 100 + [[0, 1]]] * 2)
    with pytest.raises(ValueError):
        ld.calc_pairwise_rogers_huff_r2(rare)
    assert ld.calc_pairwise_rogers_huff_r2(rare, check_no_mafs_above=None).count() == 1


def test_pca_and_pcoa(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame(rng.normal(size=(30, 4)) @ rng.normal(size=(4, 4)), columns=list("abcd"))
    found = ordination.do_pca(data)
    z = (data - data.mean()) / data.std(ddof=0)
    assert np.allclose(z.to_numpy() @ found["princomps"].to_numpy().T, found["projections"])
    assert abs(found["explained_variance (%)"].sum() - 100) < 1e-9
    with pytest.raises(ValueError):
        ordination.do_pca(data, center_data=False)
    vector = [0.2, 0.3, 0.9, 0.9, 0.1, 0.8, 0.7, 0.7, 0.8, 0.2]
    held = dists.Distances.from_vector(spark, vector, [f"i{k}" for k in range(1, 6)])
    first = ordination.do_pcoa(held)["projections"]["PC0"]
    assert abs(first["i1"] - first["i2"]) < abs(first["i1"] - first["i4"])
    with pytest.raises(ValueError):
        ordination.do_pcoa(dists.Distances.from_vector(spark, [0.1, None, 0.2]))


def test_pca_with_vars(spark):
    rng = np.random.default_rng(2)
    held = frame(spark, rng.integers(0, 2, (40, 8, 2)))
    coded = np.array([r.coded for r in ordination.create_012_gt_matrix(held).orderBy("var_id").collect()], float)
    direct = ordination.do_pca(pd.DataFrame(coded.T))
    found = ordination.do_pca_with_vars(held)
    assert np.allclose(found["explained_variance"][:5], direct["explained_variance"][:5])
    assert np.allclose(np.abs(found["projections"].iloc[:, :3]), np.abs(direct["projections"].iloc[:, :3]))
    axes = ordination.principal_axes(held, found["projections"].iloc[:, :2]).orderBy("var_id").collect()
    assert np.allclose(np.abs([a.loadings[0] for a in axes]), np.abs(direct["princomps"].iloc[0]))


def test_frame_checks(spark):
    with pytest.raises(ValueError):
        frame(spark, HET, samples=["a", "a", "b", "c"])
    with pytest.raises(ValueError):
        frame(spark, HET, samples=["a"])
    with pytest.raises(ValueError):
        frame(spark, [[0, 1]])
    with pytest.raises(ValueError):
        frame(spark, np.array(HET, dtype=float))
    with pytest.raises(ValueError):
        frame(spark, HET, vars_info={"chrom": ["1"]})
    held = frame(spark, HET, samples=list("abcd"))
    assert held.num_samples == 4 and held.first_chunks(1, 2).df.count() == 2
    assert kept(held.get_vars([0, 2])) == [0, 2] and kept(held.get_vars(slice(1, 3))) == [1, 2]
    masked = np.ma.masked_equal(np.array(HET), 1)
    assert -1 in VariantFrame.from_gt_array(spark, masked).df.orderBy("var_id").first().gts


def test_repartition_changes_nothing(spark):
    rng = np.random.default_rng(4)
    held = frame(spark, rng.integers(-1, 3, (50, 6, 2)))
    other = held.with_df(held.df.repartition(7))
    for f in (lambda v: stats.exp_het_per_var(v, None, 1), stats.calc_per_sample_stats, lambda v: dists.calc_pairwise_kosman_dists(v).df):
        assert sorted(map(str, f(held).collect())) == sorted(map(str, f(other).collect()))


def test_pipeline(spark):
    held = frame(spark, HET)
    count = lambda batch: pd.DataFrame({"n": [len(batch)]})
    made = Pipeline([count], "n long")
    assert sum(r.n for r in made.map_chunks(held).collect()) == 3
    with pytest.raises(ValueError):
        made.map_and_reduce(held)
    made.set_reduce_funct(lambda df: df.agg(F.sum("n").alias("n")))
    assert made.map_and_reduce(held).first().n == 3
    with pytest.raises(ValueError):
        made.map_chunks(held)


def test_ld_per_pop_keeps_all_pairs(spark):
    gts = np.random.default_rng(5).integers(0, 2, size=(40, 8, 2)).tolist()
    held = frame(spark, gts)
    held = held.with_df(held.df.withColumn("chrom", F.lit("1")).withColumn("pos", F.col("var_id") * 10))
    options = {"max_dist": 100, "max_allowed_maf": 1.0}
    whole = ld.get_ld_and_dist_for_pops(held, max_num_measures_to_keep=None, **options)
    capped = ld.get_ld_and_dist_for_pops(held, max_num_measures_to_keep=50, **options)
    found = {(r.var_id1, r.var_id2) for r in whole.collect()}
    assert found > {(r.var_id1, r.var_id2) for r in capped.collect()} and capped.count() == 50
    assert found == {(r.var_id1, r.var_id2) for r in ld.calc_pairwise_rogers_huff_r2(held, 100, None).where("r2 is not null and dist_in_bp > 1").collect()}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared test tables")
def test_ld_per_pop_min_dist_has_no_limit(spark):
    plan = genetics_queries.ld_per_pop_min_dist(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan


def test_rows_by_place(spark):
    held = frame(spark, np.random.default_rng(1).integers(0, 3, (10, 4, 2)))
    ids = lambda f: [r.var_id for r in f.df.orderBy("var_id").collect()]
    every = list(range(10))
    mask = [i > 6 for i in every]
    assert ids(held.get_vars(mask)) == ids(held.get_vars(np.array(mask))) == [7, 8, 9]
    assert ids(held.get_vars(np.array([-1, 2, 2]))) == [2, 9]
    for cut in (slice(-3, None), slice(None, None, -3), slice(8, 2, -2), slice(2, -2, 3), slice(5, 5), slice(20, None)):
        assert ids(held.get_vars(cut)) == sorted(every[cut]), cut
    sparse = held.get_vars(F.col("var_id").isin(1, 4, 6, 9))
    assert ids(sparse.get_vars(slice(-2, None))) == [6, 9] and ids(sparse.get_vars([0, -1])) == [1, 9]
    far = held.with_df(held.df.withColumn("var_id", F.col("var_id") * 2**33 + 5))
    assert ids(far.get_vars([False] * 8 + [True] * 2)) == [8 * 2**33 + 5, 9 * 2**33 + 5]
    assert held.get_vars([]).df.count() == 0 and held.get_vars(slice(0, 3)).df.columns == held.df.columns
    with pytest.raises(IndexError):
        held.get_vars([10])
    with pytest.raises(IndexError):
        held.get_vars([True])
    with pytest.raises(TypeError):
        held.get_vars([1.5])


def test_matrix_cells_on_demand(spark):
    gts = np.random.default_rng(2).integers(0, 2, (9, 12, 2))
    held = frame(spark, gts, vars_info={"chrom": ["a"] * 5 + ["b"] * 4, "pos": [10 * i for i in range(9)]})
    matrix = ld.linkage_matrix(held, None, block=2)
    assert matrix.tiles.where("a > b").isEmpty() and matrix.tiles.count() > 3
    whole = {(r.var_id1, r.var_id2): (r.r2, r.dist_in_bp) for r in matrix.cells().collect()}
    assert len(whole) == 81
    x = (gts != 0).sum(axis=2)
    major = [0 if (g == 0).sum() >= (g == 1).sum() else 1 for g in gts]
    x = np.array([(g != m).sum(axis=1) for g, m in zip(gts, major, strict=True)])
    wanted = np.corrcoef(x)
    for (i, j), (r, gap) in whole.items():
        assert abs(r - wanted[i, j]) < 1e-9
        assert gap == (abs(i - j) * 10 if (i < 5) == (j < 5) else None)
    some = {(r.var_id1, r.var_id2): (r.r2, r.dist_in_bp) for r in matrix.cells(rows=[7, 1], columns=[1, 2, 8]).collect()}
    assert some == {k: v for k, v in whole.items() if k[0] in (1, 7) and k[1] in (1, 2, 8)}
    near = {(r.var_id1, r.var_id2): (r.r2, r.dist_in_bp) for r in ld.calc_rogers_huff_r2_matrix(held, 20, None).collect()}
    assert near == {k: v for k, v in whole.items() if v[1] is not None and v[1] <= 20}


def crowd(spark, n=60):
    gts = np.random.default_rng(12).integers(-1, 3, (n, 7, 2))
    info = {"chrom": [None if i % 11 == 0 else f"c{i % 3}" for i in range(n)], "pos": [None if i % 13 == 0 else 10 * i for i in range(n)]}
    return frame(spark, gts, vars_info=info), info


def test_rows_of_the_matrix_do_not_store_it(spark):
    """What is stored is a copy of each variant; only blocks with the rows meet the others, without a shuffle."""
    held, _ = crowd(spark)
    matrix = ld.linkage_matrix(held, None, block=7)
    assert matrix.blocks.agg(F.sum(F.size("var_id"))).first()[0] == 60 and matrix.blocks.count() > 5
    some = matrix.cells(rows=[3, 44])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    whole = {(r.var_id1, r.var_id2): r for r in matrix.cells().collect()}
    assert len(whole) == 3600 and {(r.var_id1, r.var_id2): r for r in some.collect()} == {k: v for k, v in whole.items() if k[0] in (3, 44)}
    tile = matrix.tiles.where("a < b").first()
    r = np.frombuffer(tile.r).reshape(len(tile.ids_a), len(tile.ids_b))
    assert [[whole[i, j].r2 for j in tile.ids_b] for i in tile.ids_a] == np.where(np.isnan(r), None, r).tolist()
    assert len(tile.pos_b) == len(tile.chroms_b) == len(tile.ids_b)


def test_pairs_meet_without_copies(spark):
    """Each pair once, from blocks that meet where they are stored; populations meet only their own variants."""
    held, info = crowd(spark)
    pairs = ld.calc_pairwise_rogers_huff_r2(held, check_no_mafs_above=None, block=7)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    found = pairs.collect()
    assert sorted((r.var_id1, r.var_id2) for r in found) == [(i, j) for i in range(60) for j in range(i + 1, 60)]
    coded = {r.var_id: r.coded for r in ld.coded_variants(held).collect()}
    for r in found:
        one, two = coded[r.var_id1], coded[r.var_id2]
        close([r.r2], [numpy_r(one, two) if np.std(one) and np.std(two) else None])
        places = [info[k][i] for k, i in (("chrom", r.var_id1), ("pos", r.var_id1), ("chrom", r.var_id2), ("pos", r.var_id2))]
        assert [r.chrom1, r.pos1, r.chrom2, r.pos2] == places
        assert r.dist_in_bp == (abs(r.pos1 - r.pos2) if r.chrom1 == r.chrom2 and None not in places else None)
    pops = {"x": held.samples[:4], "y": held.samples[3:]}
    far, near = (ld.get_ld_and_dist_for_pops(held, pops, max_dist=m, max_allowed_maf=1.0, max_num_measures_to_keep=None).collect() for m in (None, 10_000))
    assert sorted(far) == sorted(near) and {r["pop"] for r in far} == {"x", "y"}


@pytest.mark.parametrize(("rows", "columns"), [(1_000, 1_000), (3, 200_000), (70_000, 1), (0, 5), (5, 0)])
def test_cells_are_made_by_slices(rows, columns):
    """However large two blocks are, a task holds so many of their pairs."""
    cuts = blocks.slices(rows, columns)
    assert [k for c in cuts for k in range(rows)[c]] == list(range(rows))
    assert all(len(range(rows)[c]) * columns <= blocks.PAIRS + columns for c in cuts)


def test_whole_matrix_is_not_stored(spark, monkeypatch):
    """The cells of the whole matrix come from blocks of variants: no stored table has rows of tiles."""
    stored = []
    for module in (ld, blocks):
        monkeypatch.setattr(module, "materialise", lambda f, label, real=scratch.materialise, **o: stored.append(label) or real(f, label, **o))
    held, info = crowd(spark)
    found = ld.calc_rogers_huff_r2_matrix(held, check_no_mafs_above=None).collect()
    assert sorted(stored) == ["ld-blocks", "ld-coded"]
    coded = {r.var_id: r.coded for r in ld.coded_variants(held).collect()}
    assert len({(r.var_id1, r.var_id2) for r in found}) == len(found) == 3600
    for r in found:
        one, two, (i, j) = coded[r.var_id1], coded[r.var_id2], (r.var_id1, r.var_id2)
        close([r.r2], [numpy_r(one, two) if np.std(one) and np.std(two) else None])
        near = info["chrom"][i] is not None and info["chrom"][i] == info["chrom"][j] and None not in (info["pos"][i], info["pos"][j])
        assert r.dist_in_bp == (abs(i - j) * 10 if near else None)


def by_sums(spark, n=1_500):
    """Variants of 32 samples on ten chromosomes; neighbours have different sums."""
    gts = np.random.default_rng(21).choice([0, 0, 0, 1, 2], (n, 32, 2))
    return frame(spark, gts, vars_info={"chrom": [f"c{i * 7 % 10}" for i in range(n)], "pos": [100 * i + 1 for i in range(n)]})


def test_written_matrix_takes_little_disk(spark, tmp_path):
    """Variants of equal sums stand in the same blocks, whose cells have few different values; columns repeat in whole bytes."""
    cells = ld.linkage_matrix(by_sums(spark), None, block=250).cells().withColumn("r2", F.round("r2", 6))
    assert bytes_a_row(cells, tmp_path / "cells") < 3.2
    assert cells.count() == 1_500 * 1_500


def test_written_pairs_take_little_disk(spark, tmp_path):
    """Each pair once, with the columns of a block's later variants repeated in whole bytes."""
    pairs = ld.calc_pairwise_rogers_huff_r2(by_sums(spark, 2_000), check_no_mafs_above=None, block=1_000).withColumn("r2", F.round("r2", 6))
    assert bytes_a_row(pairs, tmp_path / "pairs") < 4
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "pairs").glob("*.parquet")]
    columns = [m.row_group(g).column(k) for m in files for g in range(m.num_row_groups) for k in range(m.num_columns)]
    assert sum(c.total_compressed_size for c in columns if c.path_in_schema in ("var_id2", "pos2")) / sum(m.num_rows for m in files) < 0.6
    assert pairs.where("var_id1 < var_id2").select("var_id1", "var_id2").distinct().count() == pairs.count() == 2_000 * 1_999 / 2



def test_sample_is_of_lowest_digests(spark):
    import hashlib

    gts = np.random.default_rng(4).integers(0, 2, (12, 10, 2))
    held = frame(spark, gts, samples=[f"s{i}" for i in range(10)], vars_info={"chrom": ["a"] * 12, "pos": [5 * i for i in range(12)]})
    pops = {"x": [f"s{i}" for i in range(6)], "y": [f"s{i}" for i in range(4, 10)]}
    every = ld.get_ld_and_dist_for_pops(held, pops, max_num_measures_to_keep=None).collect()
    few = ld.get_ld_and_dist_for_pops(held, pops, max_num_measures_to_keep=7)
    order = lambda r: hashlib.md5(f"{r.var_id1}:{r.var_id2}:42".encode()).hexdigest()
    wanted = {p: sorted((r for r in every if r["pop"] == p), key=order)[:7] for p in pops}
    assert {p: sorted((r for r in few.collect() if r["pop"] == p), key=order) for p in pops} == wanted


def kosman_by_definition(gts, i, j):
    """Summed distances and shared variants of two samples, allele by allele."""
    total, n = 0.0, 0
    for x, y in zip(gts[:, i].tolist(), gts[:, j].tolist(), strict=True):
        if -1 not in x and -1 not in y:
            held = sum(a in y for a in x) + sum(b in x for b in y)
            total, n = total + {0: 1.0, 4: 0.0}.get(held, 0.5), n + 1
    return total, n


@pytest.mark.parametrize("block", [1, 3, 4, 50])
def test_kosman_tiles(spark, block):
    rng = np.random.default_rng(block)
    gts = rng.integers(-1, 6, (150, 11, 2))
    gts[:40] = rng.integers(0, 2, (40, 11, 2))
    held = frame(spark, gts)
    held = held.with_df(held.df.repartition(3))
    found = {(r.i, r.j): (r.total, r.n) for r in dists.kosman_sums(held, block=block).collect()}
    assert found == {(i, j): kosman_by_definition(gts, i, j) for i in range(11) for j in range(i + 1, 11)}
    some = {(r.i, r.j): (r.total, r.n) for r in dists.kosman_sums(held, [7, 2, 5], [2, 9, 0, 10], block=min(block, 3)).collect()}
    assert some == {(i, j): kosman_by_definition(gts, i, j) for i in (7, 2, 5) for j in (2, 9, 0, 10)}
    nothing = held.with_df(held.df.where("var_id < 0"))
    assert {(r.total, r.n) for r in dists.kosman_sums(nothing, block=block).collect()} == {(0.0, 0)}


def test_landmarks_stay_in_spark(spark, monkeypatch):
    gts = np.random.default_rng(6).integers(-1, 3, (80, 9, 2))
    held = frame(spark, gts)
    monkeypatch.setattr(type(held.df), "toPandas", lambda self: pytest.fail("a table reached the driver"))
    found = {(r.i, r.j): r.dist for r in dists.kosman_by_embedding(held, seeds=[0, 4], max_rounds=1).df.collect()}
    square = np.array([[0.0 if i == j else np.divide(*kosman_by_definition(gts, i, j)) for j in range(9)] for i in range(9)])
    far = {int(square[s].argmax()) for s in (0, 4)}
    seeds = sorted({0, 4, *far, *(int(square[s].argmax()) for s in far)})
    for (i, j), d in found.items():
        assert abs(d - np.linalg.norm(square[seeds, i] - square[seeds, j])) < 1e-9
    assert len(found) == 36
    with pytest.raises(ValueError, match="numbers of samples"):
        dists.kosman_by_embedding(held, seeds=[9])


def test_fold_with_an_initializer(spark):
    from functools import reduce

    gts = np.random.default_rng(3).integers(-1, 3, (90, 3, 2))
    held = frame(spark, gts)
    held = held.with_df(held.df.repartitionByRange(40, "var_id"))

    def listed(batch):
        return {"ids": batch["var_id"].tolist(), "sums": {int(i): int(g.sum()) for i, g in zip(batch["var_id"], batch["gts"], strict=True)}}

    def join(one, two):
        return {"ids": one["ids"] + two["ids"], "sums": {**one["sums"], **two["sums"]}}  # the order of ids shows that it isn't commutative

    first = {"ids": [], "sums": {}}
    pipeline = Pipeline([listed], reduce_funct=join, reduce_initializer=first)
    wanted = reduce(join, [{"ids": [i], "sums": {i: int(g.sum())}} for i, g in enumerate(gts.reshape(90, -1))], first)
    assert pipeline.map_and_reduce(held) == wanted and first == {"ids": [], "sums": {}}
    assert pipeline.map_and_reduce(held.with_df(held.df.where("var_id < 0"))) == first
    plain = Pipeline([lambda b: len(b)])
    plain.set_reduce_funct(lambda a, b: a + b)
    assert plain.map_and_reduce(held) == 90
    # states of another kind than what is mapped need a merge of their own
    counted = Pipeline([lambda b: len(b)], reduce_funct=lambda s, n: [*s, n], reduce_initializer=[], merge_funct=lambda a, b: a + b, after_reduce_funct=sum)
    assert counted.map_and_reduce(held) == 90
    with pytest.raises(ValueError, match="reduces"):
        pipeline.map_chunks(held)
    with pytest.raises(ValueError, match="schema"):
        Pipeline([listed]).map_chunks(held)


def test_filters_count_while_they_run(spark):
    gts = np.random.default_rng(5).integers(-1, 3, (60, 8, 2))
    held = frame(spark, gts, samples=[f"s{i}" for i in range(8)])

    def chain(v):
        v = filters.filter_by_missing_data(v, 0.6)
        v = filters.filter_by_maf(v.get_vars(F.col("var_id") < 50), 0.6)
        return filters.filter_by_missing_data(filters.filter_samples(v, ["s1", "s2", "s3"]), 0.4)

    counted, counts = filters.counting(held)
    done = chain(counted)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    rows = done.df.collect()
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - jobs
    assert ran == 1 and len(rows) == chain(held).df.count()
    found = {k: (v["vars_processed"], v["vars_kept"]) for k, v in counts.stats().items()}
    plain = chain(held)
    wanted = {r.kind: (r.vars_processed, r.vars_kept) for r in filters.gather_filtering_stats(plain).collect()}
    assert found == wanted and found["maf"][0] < 60
    ld_counted, ld_counts = filters.counting(held)
    kept = filters.filter_by_ld_and_maf(ld_counted, 0.1, 0.95)
    n = kept.df.count()  # counts are there once an action has run
    assert ld_counts.stats() == {"ld_and_maf": {"vars_processed": 60, "vars_kept": n}}


def test_workers_of_another_folder_find_the_package():
    """Python workers that start elsewhere, without the package on their path, get it with the query."""
    import subprocess
    import sys
    import textwrap

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from locusflow.plans.queries import QUERIES
        for name in ("ld_max_dist", "kosman_tiles", "ld_filter", "pca_gram", "fold_missing"):
            assert QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1, name
        print("all found")
    """)
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the shared test tables")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=400, check=False)
    assert "all found" in done.stdout, done.stderr[-2000:]


def scanned(x, limit):
    """The greedy scan, one variant after another."""
    kept = []
    for i, row in enumerate(x):
        r = filters.signed_r(x[kept[-1]], row) if kept else 0.0
        if r is not None and abs(r) < limit:
            kept.append(i)
    return kept


def coded_frame(spark, x, size):
    return spark.createDataFrame([("", i // size, i, row.tolist()) for i, row in enumerate(x)], "lane string, chunk long, var_id long, coded array<int>")


@pytest.mark.parametrize(("size", "limit"), [(3, 0.1), (5, 0.4), (50, 0.2)])
def test_scan_in_stretches(spark, size, limit):
    x = np.random.default_rng(size).integers(-1, 3, (90, 12))
    x[30:60] = x[7]  # many stretches that keep nothing, or no variance
    x[70] = 1
    state, _ = filters.greedy_scan(coded_frame(spark, x, size), limit)
    assert sorted(i for r in state.collect() for i in r.kept) == scanned(x, limit)


def test_chains_of_stretches_take_few_rounds(spark):
    """Each stretch alone would end with genotypes of its own, all near those of the first variant."""
    rng = np.random.default_rng(2)
    base = np.repeat([0, 2], 60)
    x = np.array([np.where(rng.random(120) < 0.05, 1, base) for _ in range(96)])
    assert scanned(x, 0.5) == [0] and len({tuple(r) for r in x.tolist()}) > 90
    state, rounds = filters.greedy_scan(coded_frame(spark, x, 2), 0.5)  # 48 stretches
    assert [i for r in state.collect() for i in r.kept] == [0] and rounds <= 4


def test_given_alleles(spark):
    held = frame(spark, HET)
    assert stats.allele_freqs_per_var(held, min_num_samples=1, alleles=[0, 1]).count() == stats.allele_freqs_per_var(held, min_num_samples=1).count()
    with pytest.raises(ValueError, match="alleles"):
        stats.allele_freqs_per_var(held, alleles=[0])
