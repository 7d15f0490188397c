import gzip
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from locusflow.frame import VariantFrame
from locusflow.operators import stats
from locusflow.sources import vcf_format
from locusflow.sources.array_folder import write_array_folder
from locusflow.sources.native import load_vars, read_zones, write_vars
from locusflow.sources.vcf import VCFKind, guess_kind, vars_from_vcf
from locusflow.streaming.drops import process_drops

HEAD = "##fileformat=VCFv4.5\n##source=made up\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tn1\tn2\tn3\n"
ROWS = [
    "7\t1201\tk1\tC\tT\t41\tPASS\tDP=9\tGT:GQ\t1|0:12\t2|7:9\t0/300:7",
    "7\t1350\t.\tA\tG\t.\tlow\tDP=4\tGT:GQ\t0|.:5\t1|1:8\t0/0:6",
    "21\t5\tx\tT\t.\t3.5\tPASS\tNS=3\tDP:GT\t7:0/0\t8:.\t9:./.",
    "21\t9\t.\tAC\tG,GTCT\t50\tPASS\t.\tGT\t0/1\t0/2\t./.",
]


def write(path, text, zipped=False):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if zipped else data)
    return str(path)


@pytest.mark.parametrize(("name", "zipped"), [("a.vcf", False), ("b.vcf.gz", True), ("c.vcf", True)])
def test_vcf(spark, tmp_path, name, zipped):
    path = write(tmp_path / name, HEAD + "\n".join(ROWS) + "\n", zipped)
    assert guess_kind(spark, path) is (VCFKind.GZIP if zipped else VCFKind.VCF)
    held = vars_from_vcf(spark, path)
    assert held.samples == ("n1", "n2", "n3") and held.ploidy == 2
    rows = held.df.orderBy("var_id").collect()
    assert [r.var_id for r in rows] == [0, 1, 2, 3]
    assert [r.gts for r in rows] == [[1, 0, 2, 7, 0, 300], [0, -1, 1, 1, 0, 0], [0, 0, -1, -1, -1, -1], [0, 1, 0, 2, -1, -1]]
    assert [(r.chrom, r.pos, r.id, r.qual) for r in rows] == [("7", 1201, "k1", 41.0), ("7", 1350, None, None), ("21", 5, "x", 3.5), ("21", 9, None, 50.0)]
    assert [r.alleles for r in rows] == [["C", "T"], ["A", "G"], ["T"], ["AC", "G", "GTCT"]]


def test_calls_of_fewer_alleles_keep_the_places_of_later_samples(spark, tmp_path):
    rows = ["X\t1\t.\tG\tA\t.\t.\t.\tGT\t0\t1/1\t0/1", "X\t2\t.\tG\tA\t.\t.\t.\tGT\t1|0\t.\t1", "X\t3\t.\tG\tA\t.\t.\t.\tGT\t1|0"]
    held = vars_from_vcf(spark, write(tmp_path / "x.vcf", HEAD + "\n".join(rows) + "\n"))
    assert held.ploidy == 2
    assert [r.gts for r in held.df.orderBy("pos").collect()] == [[0, -1, 1, 1, 0, 1], [1, 0, -1, -1, 1, -1], [1, 0, -1, -1, -1, -1]]
    more = vars_from_vcf(spark, write(tmp_path / "y.vcf", HEAD + rows[1] + "\n" + rows[0].replace("1/1", "1/1/1") + "\n"))
    with pytest.raises(Exception, match="more than 2 alleles"):
        more.df.collect()


@pytest.mark.parametrize("zipped", [False, True])
def test_long_header(spark, tmp_path, zipped):
    notes = "".join(f"##note={i}-{hash(str(i))}\n" for i in range(9_000))
    held = vars_from_vcf(spark, write(tmp_path / "long", notes + HEAD + ROWS[0] + "\n", zipped))
    assert held.samples == ("n1", "n2", "n3") and held.df.count() == 1


@pytest.mark.parametrize("text", ["no header\n", HEAD, "##only\n", HEAD.replace("REF", "REV") + ROWS[0] + "\n"])
def test_bad_vcf(spark, tmp_path, text):
    with pytest.raises(ValueError):
        vars_from_vcf(spark, write(tmp_path / "bad.vcf", text))


def test_round_trip(spark, tmp_path):
    gts = np.random.default_rng(0).integers(-1, 3, (20, 4, 2))
    info = {"chrom": [f"c{i % 2}" for i in range(20)], "pos": list(range(20))}
    held = VariantFrame.from_gt_array(spark, gts, ["a", "b", "c", "d"], info, alleles=[["A", "T"]] * 20)
    write_vars(held, str(tmp_path / "out"))
    back = load_vars(spark, str(tmp_path / "out"))
    assert back.samples == held.samples and back.ploidy == 2
    assert back.df.orderBy("var_id").collect() == held.df.orderBy("var_id").collect()
    with pytest.raises(Exception, match="(?i)exist"):
        write_vars(held, str(tmp_path / "out"))


def located(spark, n=400):
    gts = np.random.default_rng(8).integers(-1, 3, (n, 3, 2))
    order = np.random.default_rng(9).permutation(n)
    info = {"chrom": [f"c{i // 100}" for i in order], "pos": [10 * int(i) for i in order], "score": [i / 2 for i in range(n)]}
    return VariantFrame.from_gt_array(spark, gts, ["a", "b", "c"], info)


def files_read(df):
    """Files that an action has opened, by Spark's own count."""
    df.select("gts").write.format("noop").mode("overwrite").save()
    return len(df.inputFiles())


def test_regions_open_the_files_they_need(spark, tmp_path):
    held, path = located(spark), str(tmp_path / "out")
    write_vars(held, path, num_parts=10)
    zones = read_zones(spark, path).orderBy("start_chrom", "start_pos").collect()
    assert len(zones) == 10 and sum(z.n for z in zones) == 400
    assert all((x.end_chrom, x.end_pos) < (y.start_chrom, y.start_pos) for x, y in zip(zones, zones[1:], strict=False))
    for region, (low, high) in ((("c1",), (1000, 1990)), (("c2", 2950), (2950, 2990)), (("c0", 120, 450), (120, 450)), (("c3", 3400, 3400), (3400, 3400))):
        found = load_vars(spark, path, region)
        wanted = held.df.where(F.col("pos").between(low, high) & (F.col("chrom") == region[0]))
        assert found.df.orderBy("var_id").collect() == wanted.orderBy("var_id").collect() and wanted.count()
        needed = [z for z in zones if (z.start_chrom, z.start_pos) <= (region[0], high) and (z.end_chrom, z.end_pos) >= (region[0], low)]
        assert files_read(found.df) == len(needed) < 6
    assert load_vars(spark, path, ("c9",)).df.count() == 0 and load_vars(spark, path).df.count() == 400
    bare = VariantFrame.from_gt_array(spark, np.zeros((4, 2, 2), int))
    write_vars(bare, str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="positions"):
        load_vars(spark, str(tmp_path / "bare"), ("c1",))


def save(path, array):
    with gzip.open(path, "wb") as out:
        np.save(out, array)


@pytest.mark.parametrize("named", [True, False])
def test_folder_of_arrays(spark, tmp_path, named):
    """A folder laid out by hand, chunks not in the order of their names, sizes that differ."""
    rng = np.random.default_rng(4)
    parts = [(name, rng.integers(0, 4, (n, 3, 2)), rng.random((n, 3, 2)) < 0.2) for name, n in (("chunk_0001", 7), ("chunk_0000", 3), ("chunk_0002", 5))]
    for name, gts, mask in parts:
        folder = tmp_path / name
        folder.mkdir()
        save(folder / "gts.npy.gz", gts.astype(np.int16))
        save(folder / "gt_mask.npy.gz", mask)
        if name != "chunk_0002":
            info = {"chrom": pd.Series([name] * len(gts), dtype="string"), "pos": pd.Series(range(len(gts)), dtype="UInt64"), "qual": pd.Series([None, *[0.5] * (len(gts) - 1)], dtype="Float32")}
            pd.DataFrame(info).to_parquet(folder / "vars_info.parquet")
    metadata = {"var_dir_format_version": "1.0", "var_chunks_metadata": [{"dir": p[0]} for p in parts], "num_samples": 3, "ploidy": 2}
    (tmp_path / "var_dir_metadata.json").write_text(json.dumps({**metadata, **({"samples": ["x", "y", "z"]} if named else {})}))
    held = load_vars(spark, str(tmp_path))
    assert held.samples == (("x", "y", "z") if named else (0, 1, 2)) and held.ploidy == 2
    rows = held.df.orderBy("var_id").collect()
    wanted = np.concatenate([np.where(m, -1, g) for _, g, m in parts]).reshape(15, -1).tolist()
    assert [r.gts for r in rows] == wanted and [r.var_id for r in rows] == list(range(15))
    assert [r.chrom for r in rows] == ["chunk_0001"] * 7 + ["chunk_0000"] * 3 + [None] * 5
    assert [r.pos for r in rows] == [*range(7), *range(3), *[None] * 5]
    assert [r.qual for r in rows] == [None, *[0.5] * 6, None, 0.5, 0.5, *[None] * 5]


def test_arrays_round_trip(spark, tmp_path):
    held, path = located(spark, 90), str(tmp_path / "arrays")
    write_array_folder(held, path, chunk_size=40)
    assert sorted(p.name for p in (tmp_path / "arrays").iterdir()) == ["chunk_0000", "chunk_0001", "chunk_0002", "var_dir_metadata.json"]
    back = load_vars(spark, path)
    assert back.samples == held.samples
    assert back.df.orderBy("var_id").collect() == held.df.orderBy("var_id").select(back.df.columns).collect()
    described = json.loads((tmp_path / "arrays" / "var_dir_metadata.json").read_text())["var_chunks_metadata"]
    first = held.df.orderBy("var_id").first()
    assert described[0]["start_chrom"] == first.chrom and described[0]["start_pos"] == first.pos
    assert load_vars(spark, path, ("c0", 100)).df.count() == held.df.where("chrom = 'c0' and pos >= 100").count()
    with pytest.raises(FileExistsError):
        write_array_folder(held, path)


def test_drops(spark, tmp_path):
    gts = np.random.default_rng(0).integers(0, 2, (6, 4, 2))
    held = VariantFrame.from_gt_array(spark, gts)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    held.df.write.parquet(folder)
    run = lambda: process_drops(spark, folder, out, checkpoint, held.samples, 2, stats.obs_het_per_var)
    assert run() == 6 and run() == 0
    held.df.where("var_id < 2").write.mode("append").parquet(folder)
    assert run() == 2
    assert spark.read.parquet(out).count() == 8


def made_up(n, start=0):
    rng = np.random.default_rng(start)
    calls = rng.choice([".", "0/0", "0/1", "1|1", "1/2"], (n, 3))
    return [f"c{i // 40}\t{10 * i}\tv{i}\tA\tC,G\t{i % 50}\tPASS\t{'x' * int(rng.integers(0, 90))}\tGT\t" + "\t".join(row) for i, row in enumerate(calls.tolist(), start)]


def bgzip(text, size):
    data = text.encode()
    return b"".join(vcf_format.member(data[k : k + size]) for k in range(0, len(data), size)) + vcf_format.CLOSING


@pytest.mark.parametrize(("block", "split"), [(700, 500), (65_000, 1_000), (333, 40), (2_000, 10**9), (41, 97)])
def test_bgzip_in_splits(spark, tmp_path, block, split):
    lines = made_up(120)
    plain = vars_from_vcf(spark, write(tmp_path / "plain.vcf", HEAD + "\n".join(lines) + "\n")).df.orderBy("var_id").collect()
    assert [(r.var_id, r.id) for r in plain] == [(i, f"v{i}") for i in range(120)]
    (tmp_path / "zipped").write_bytes(bgzip(HEAD + "\n".join(lines) + "\n", block))
    held = vars_from_vcf(spark, str(tmp_path / "zipped"), split_bytes=split)
    assert held.df.orderBy("var_id").collect() == plain
    vcf_format.register(spark)
    raw = spark.read.format("vcf").schema("part int, id string").option("splitBytes", split).load(str(tmp_path / "zipped"))
    assert raw.rdd.getNumPartitions() == -(-(tmp_path / "zipped").stat().st_size // split)
    if (block, split) == (700, 500):
        assert raw.select("part").distinct().count() > 3  # several tasks have lines


@pytest.mark.parametrize("split", [1, 7, 64, 5_000])
def test_plain_lines_have_one_owner(tmp_path, split):
    text = "#h\n\na\tb\n" + "long" * 40 + "\tz\n\n" + "\n".join(f"r{i}\t{i}" for i in range(30))
    path = write(tmp_path / "x.vcf", text)
    reader = vcf_format.VcfReader(StructType.fromDDL("part int, nth long, chrom string"), {"path": path, "splitBytes": str(split)})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    found = [x for b in batches for x in b.column("chrom").to_pylist()]
    assert found == ["a", "long" * 40, *(f"r{i}" for i in range(30))]
    places = [(p, n) for b in batches for p, n in zip(b.column("part").to_pylist(), b.column("nth").to_pylist(), strict=True)]
    assert places == sorted(set(places))


def test_folder_is_numbered_by_name(spark, tmp_path):
    """Spark deals large files first; ids follow the names."""
    folder = tmp_path / "parts"
    folder.mkdir()
    lines = made_up(300)
    for name, own in (("a", [HEAD.rstrip()] + lines[:5]), ("b", lines[5:290]), ("c", lines[290:292]), ("d", []), ("e", lines[292:])):
        write(folder / name, "".join(x + "\n" for x in own))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        held = vars_from_vcf(spark, str(folder))
        assert held.df.rdd.getNumPartitions() > 3
        assert [(r.var_id, r.id) for r in held.df.orderBy("var_id").collect()] == [(i, f"v{i}") for i in range(300)]
        assert [r.id for r in held.get_vars(slice(-2, None)).df.orderBy("var_id").collect()] == ["v298", "v299"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="splits"):
        held.df.select("*").collect()  # planned anew


def test_format_reads_what_is_asked_for(spark, tmp_path):
    path = write(tmp_path / "a.vcf.gz", HEAD + "\n".join(ROWS) + "\n", True)
    vcf_format.register(spark)
    rows = spark.read.format("vcf").load(path).orderBy("nth").collect()
    assert [(r.chrom, r.pos, r.ref, r.alt, r.qual, r.filter, r.calls) for r in rows][:2] == [
        ("7", 1201, "C", "T", 41.0, "PASS", ["1|0:12", "2|7:9", "0/300:7"]), ("7", 1350, "A", "G", None, "low", ["0|.:5", "1|1:8", "0/0:6"])
    ]
    assert [r.pos for r in spark.read.format("vcf").schema("pos long").load(path).collect()] == [1201, 1350, 5, 9]
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("vcf").schema("nothing string").load(path).collect()


def test_written_bgzip_reads_back(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in [*HEAD.strip().split("\n"), *made_up(50)]], "value string").coalesce(1)
    vcf_format.write_bgzip(lines, str(tmp_path / "out"), block_bytes=300)
    held = vars_from_vcf(spark, str(tmp_path / "out"), split_bytes=400)
    assert [(r.var_id, r.id) for r in held.df.orderBy("var_id").collect()] == [(i, f"v{i}") for i in range(50)]


def test_threads_share_the_setting_of_writes(spark):
    import threading

    from locusflow.scratch import CLEANUP, discard, materialise, shuffles_end_with_queries

    before = spark.conf.get(CLEANUP)
    seen, inside, leave = [], threading.Event(), threading.Event()

    def other():
        with shuffles_end_with_queries(spark):
            inside.set()
            leave.wait(60)
            seen.append(spark.conf.get(CLEANUP))

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    table = materialise(spark.range(5), "threads")
    assert table.count() == 5
    leave.set()
    thread.join()
    assert seen == ["true"] and spark.conf.get(CLEANUP) == before
    discard(table)
