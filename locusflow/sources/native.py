"""The native layout: Parquet sorted by chromosome and position, with a zone map and a small JSON file.

The zone map (`zones`) has a row for each Parquet file: where its variants begin and end, and how
many they are. A reader that wants a region looks there first and opens the files it needs alone;
within them row-group statistics skip the rest.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import VariantFrame
from . import array_folder

FORMAT = "locusflow-2"
#: Without zones; still read.
FORMATS = (FORMAT, "locusflow-1")
ZONES = "file string, n long, start_chrom string, start_pos long, end_chrom string, end_pos long"


def write_vars(variants: VariantFrame, path: str, compression: str = "zstd", num_parts: int | None = None) -> None:
    """Write variants, alleles included; the folder must not hold a table yet.

    Rows are ranged by chrom and pos, in num_parts files or as many as Spark finds right, so that
    files and row groups are stretches of the genome.
    """
    df = variants.df
    spark = df.sparkSession
    if variants.has_positions:
        parts = () if num_parts is None else (num_parts,)
        df = df.repartitionByRange(*parts, "chrom", "pos").sortWithinPartitions("chrom", "pos", "var_id")
    elif num_parts is not None:
        df = df.repartitionByRange(num_parts, "var_id")
    df.write.option("compression", compression).parquet(f"{path}/variants")
    if variants.has_positions:
        _zones_of(spark.read.parquet(f"{path}/variants")).write.parquet(f"{path}/zones")
    metadata = {"format": FORMAT, "samples": list(variants.samples), "ploidy": variants.ploidy, "zones": variants.has_positions}
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def _zones_of(stored: DataFrame) -> DataFrame:
    """A row a file, from the two columns of positions alone."""
    place = F.struct(F.col("chrom").cast("string").alias("chrom"), F.col("pos").cast("long").alias("pos"))
    each = stored.select(F.col("_metadata.file_name").alias("file"), place.alias("at"))
    found = each.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    ends = [F.col(f"{e}.{c}").alias(f"{name}_{c}") for e, name in (("low", "start"), ("high", "end")) for c in ("chrom", "pos")]
    return found.select("file", "n", *ends).coalesce(1)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """The zone map: ZONES, a row for each file."""
    return spark.read.schema(ZONES).parquet(f"{path}/zones")


def _metadata(spark: SparkSession, path: str) -> dict:
    metadata = json.loads(spark.read.text(f"{path}/metadata").first().value)
    if metadata["format"] not in FORMATS:
        raise ValueError(f"unknown format {metadata['format']}")
    return metadata


def load_vars(spark: SparkSession, path: str, region: tuple | None = None) -> VariantFrame:
    """A written folder, in this layout or in that of array folders (see array_folder).

    region is (chrom,), (chrom, first pos) or (chrom, first pos, last pos), ends included: only
    files that reach into it are opened, and only its variants returned.
    """
    if array_folder.is_array_folder(spark, path):
        held = array_folder.load_array_folder(spark, path)
        return held if region is None else held.get_vars(_inside(held, *region))
    metadata = _metadata(spark, path)
    if region is None:
        return VariantFrame(spark.read.parquet(f"{path}/variants"), metadata["samples"], metadata["ploidy"])
    files = [f"{path}/variants"]
    if metadata.get("zones"):
        chrom, first, last = (*region, None, None)[:3]
        low = F.struct(F.lit(str(chrom)).alias("chrom"), F.lit(-(2**63) if first is None else int(first)).alias("pos"))
        high = F.struct(F.lit(str(chrom)).alias("chrom"), F.lit(2**63 - 1 if last is None else int(last)).alias("pos"))
        starts, ends = (F.struct(F.col(f"{e}_chrom").alias("chrom"), F.col(f"{e}_pos").alias("pos")) for e in ("start", "end"))
        reached = read_zones(spark, path).where((starts <= high) & (ends >= low)).select("file").orderBy("file").collect()  # files of the region
        files = [f"{path}/variants/{r.file}" for r in reached]
    # one schema for all files; a region without files reads none
    schema = spark.read.parquet(f"{path}/variants").schema
    df = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    held = VariantFrame(df, metadata["samples"], metadata["ploidy"])
    return held.get_vars(_inside(held, *region))


def _inside(variants: VariantFrame, chrom, first: int | None = None, last: int | None = None):
    if not variants.has_positions:
        raise ValueError("variants without positions have no regions")
    found = F.col("chrom") == str(chrom)
    if first is not None:
        found &= F.col("pos") >= int(first)
    return found if last is None else found & (F.col("pos") <= int(last))
