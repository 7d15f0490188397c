"""VCF files as VariantFrames.

The driver reads the header and the first record from the head of the file; records are split and
parsed by column expressions. Compressed files are recognised by their first bytes, whatever their
name. bgzip files that pyarrow can open go through the data source in vcf_format, which splits
them; all others through Spark's text reader, in any store that Spark reads. That goes by the name, so a file that
is compressed but not named .gz is copied, as a stream, to one with that name in the folder for
scratch tables.

A path may also be a folder of parts, as a Spark job writes them: the first by name begins with the
header. var_id is 0..n-1 in the order of files by name and of lines: records are counted by split
in a pass of its own, when the frame is made, the counts' running sum says where each split
begins, and records are numbered within it. A later reading whose splits are others (for a setting of
the session that has changed since) is an error.

Each sample has as many slots as the ploidy, which is the largest among the calls of the first
record. A call with fewer alleles is filled up with missing ones, so that later samples keep their places;
one with more alleles is an error. Fields left out at the end of a record count as missing.
"""

from __future__ import annotations

import gzip
import io
import zlib
from enum import Enum

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import MISSING_ALLELE
from ..frame import VariantFrame
from ..scratch import materialise, scratch_path
from . import vcf_format

#: Fixed columns of the format.
COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


#: Splits up to which the numbers that they begin at are broadcast.
MOST_SPLITS = 500_000


class VCFKind(Enum):
    VCF = "vcf"
    GZIP = "gzip"


def guess_kind(spark: SparkSession, path: str) -> VCFKind:
    head = _head(spark, path, 65_536)
    if head[:1] == b"#":
        return VCFKind.VCF
    if head[:2] == b"\x1f\x8b":
        try:
            if gzip.GzipFile(fileobj=io.BytesIO(head)).read(1) == b"#":
                return VCFKind.GZIP
        except (OSError, EOFError):
            pass
    raise ValueError(f"{path} is not a VCF file")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The path, or of a folder the files with data, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(at).isDirectory():
        return [path]
    return sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getLen() and not f.getPath().getName().startswith(("_", ".")))


def _head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, or of a folder's files in order, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    held = b""
    for name in _files(spark, path):
        at = jvm.org.apache.hadoop.fs.Path(name)
        stream = at.getFileSystem(conf).open(at)
        try:
            bounded = jvm.org.apache.commons.io.input.BoundedInputStream(stream, size - len(held))
            held += bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(bounded))
        finally:
            stream.close()
        if len(held) >= size:
            break
    return held


def _named_gz(spark: SparkSession, path: str) -> str:
    """A copy of a file under a name that ends in .gz, in the shared scratch folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(path)
    target = jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'lines')}.gz")
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    target.getFileSystem(conf).deleteOnExit(target)
    return target.toString()


def read_lines(spark: SparkSession, path: str, kind: VCFKind) -> DataFrame:
    """value (line) of each record, with file and split (where its split of the file begins), in the file's order within a split."""
    if kind is VCFKind.GZIP and _files(spark, path) == [path] and not path.endswith((".gz", ".bgz")):
        path = _named_gz(spark, path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))


def _starts(counted: DataFrame, *order: str) -> DataFrame:
    """counted (n, a row a split) with before, the records of the splits that come first; stored."""
    before = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # a few numbers a split
    return materialise(counted.withColumn("before", F.coalesce(before, F.lit(0))), "vcf-splits")


def _join_starts(records: DataFrame, starts: DataFrame, key: str, nth: Column) -> DataFrame:
    """records with var_id, from their number within the split."""
    side = F.broadcast(starts) if starts.count() <= MOST_SPLITS else starts
    checked = F.when(nth.between(0, F.col("n") - 1), F.col("before") + nth).otherwise(F.raise_error(F.lit("the file's splits aren't those that were counted")).cast("long"))
    return records.join(side, key, "left").withColumn("var_id", checked)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """var_id and f, the fields, of read_lines' records."""
    # ids rise by one from record to record within a split
    held = lines.select("value", "file", "split", F.xxhash64("file", "split").alias("of"), F.monotonically_increasing_id().alias("id"))
    counted = held.groupBy("file", "split", "of").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    starts = _starts(counted, "file", "split").drop("file", "split")
    return _join_starts(held.drop("file", "split"), starts, "of", F.col("id") - F.col("first")).select("var_id", _fields(F.col("value")).alias("f"))


def numbered_calls(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """var_id, chrom, pos, id, ref, alt, qual, format and calls, by the data source."""
    vcf_format.register(spark)
    read = lambda schema: spark.read.format("vcf").schema(schema).options(**({"splitBytes": str(split_bytes)} if split_bytes else {})).load(path)
    counted = read("part int").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    records = read("part int, nth long, chrom string, pos long, id string, ref string, alt string, qual double, format string, calls array<string>")
    return _join_starts(records, _starts(counted, "part"), "part", F.col("nth"))


def _fields(line: Column) -> Column:
    return F.split(F.rtrim(line), "\t")


def fields_as_columns(rows: DataFrame) -> DataFrame:
    """The fields f of text records under the data source's names."""
    field = lambda k: F.get("f", F.lit(k))
    known = lambda c: F.when(c != ".", c)
    return rows.select(
        "var_id", field(0).alias("chrom"), field(1).cast("long").alias("pos"), field(2).alias("id"), field(3).alias("ref"), field(4).alias("alt"),
        known(field(5)).cast("double").alias("qual"), field(8).alias("format"), F.slice("f", 10, 2**31 - 1).alias("calls"),
    )


def parse_records(records: DataFrame, num_samples: int, ploidy: int) -> DataFrame:
    """Variants as rows: var_id, chrom, pos, id, qual, alleles, gts."""
    rows = records.withColumn("gt_at", F.array_position(F.split("format", ":"), "GT"))
    all_missing = F.array_repeat(F.lit(MISSING_ALLELE), ploidy)
    absent = F.array_repeat(F.lit("."), num_samples)

    def alleles_of(sample: Column) -> Column:
        gt = F.get(F.split(sample, ":"), (F.col("gt_at") - 1).cast("int"))
        parts = F.split(gt, r"[/|]")
        parsed = F.transform(parts, lambda a: F.when(a == ".", MISSING_ALLELE).otherwise(a.cast("int")))
        filled = F.slice(F.concat(parsed, all_missing), 1, ploidy)
        too_many = F.raise_error(F.concat(F.lit(f"a call has more than {ploidy} alleles: "), gt)).cast("array<int>")
        return F.when(gt.isNull() | (gt == "."), all_missing).when(F.size(parts) > ploidy, too_many).otherwise(filled)

    return rows.select(
        "var_id", "chrom", "pos", F.when(F.col("id") != ".", F.col("id")).alias("id"), "qual",
        F.when(F.col("alt") == ".", F.array("ref")).otherwise(F.concat(F.array("ref"), F.split("alt", ","))).alias("alleles"),
        F.flatten(F.transform(F.slice(F.concat("calls", absent), 1, num_samples), alleles_of)).alias("gts"),
    )


def _head_lines(spark: SparkSession, path: str, kind: VCFKind) -> list[str]:
    """Lines from the file's start up to its first record, if it has one, from as few bytes as hold them."""
    size = 65_536
    while True:
        head = _head(spark, path, size)
        text = head
        if kind is VCFKind.GZIP:  # bgzip files are many members, one after the other
            text, rest = b"", head
            while rest[:2] == b"\x1f\x8b":
                one = zlib.decompressobj(31)
                text += one.decompress(rest)
                rest = one.unused_data
        lines = text.split(b"\n")
        whole = lines if len(head) < size else lines[:-1]
        for at, line in enumerate(whole):
            if line.strip() and not line.startswith(b"#"):
                return [x.decode() for x in whole[: at + 1]]
        if len(head) < size:
            return [x.decode() for x in whole]
        size *= 8


def read_metadata(spark: SparkSession, path: str, kind: VCFKind) -> tuple[tuple[str, ...], int]:
    """Sample names from the header and ploidy from the first record, out of the head of the file."""
    lines = _head_lines(spark, path, kind)
    header = next((x for x in lines if x.startswith("#CHROM")), None)
    if header is None:
        raise ValueError("the VCF file has no header line")
    names = header.rstrip().split("\t")
    if tuple(names[:9]) != COLUMNS:
        raise ValueError("the header line doesn't name the fixed columns")
    first = next((x for x in lines if x.strip() and not x.startswith("#")), None)
    if first is None:
        raise ValueError("Empty VCF file: it has no variants")
    fields = first.rstrip().split("\t")
    at = fields[8].split(":").index("GT")
    gts = [s.split(":")[at] for s in fields[9:]]
    ploidy = max((1 + g.count("/") + g.count("|") for g in gts if g != "."), default=2)
    return tuple(names[9:]), ploidy


def _splits_as_bgzip(spark: SparkSession, path: str) -> bool:
    """Whether the first file is of bgzip blocks that pyarrow can open."""
    if not vcf_format.member_size(_head(spark, path, 18), 0):
        return False
    try:
        store, at = vcf_format.open_store(path)
        return store.get_file_info(at).type != fs.FileType.NotFound
    except (pa.ArrowInvalid, OSError):
        return False


def vars_from_vcf(spark: SparkSession, path: str, split_bytes: int | None = None) -> VariantFrame:
    """Variants of a VCF file or folder, var_id in its order; split_bytes are those of a task's part of a bgzip file."""
    kind = guess_kind(spark, path)
    samples, ploidy = read_metadata(spark, path, kind)
    if kind is VCFKind.GZIP and _splits_as_bgzip(spark, path):
        records = numbered_calls(spark, path, split_bytes)
    else:
        records = fields_as_columns(numbered_lines(read_lines(spark, path, kind)))
    return VariantFrame(parse_records(records, len(samples), ploidy), samples, ploidy)
