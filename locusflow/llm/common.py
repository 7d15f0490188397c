"""What the operators of this subpackage share: scratch tables, code shipping, column checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, materialise, scratch_path, scratch_root, shuffles_end_with_queries
from ..shipping import ship_package

__all__ = ["discard", "materialise", "shuffles_end_with_queries", "scratch_path", "scratch_root", "ship_package", "small", "bytes_in", "ascii_lower", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes up to which a checked table is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 24 * 1024 * 1024


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """About how much memory a value takes, from its length or those of its parts."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(value, F.lit(16).cast("long"), lambda s, v: s + _bytes_of(v, kind.elementType))
        return F.coalesce(each, F.lit(16).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def bytes_in(frame: DataFrame) -> int:
    row = sum((_bytes_of(F.col(f.name), f.dataType) for f in frame.schema.fields), F.lit(16).cast("long"))
    return frame.agg(F.sum(row).alias("n")).first().n or 0


def small(frame: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored table for broadcast if it takes few bytes; else leave the join to shuffle."""
    return F.broadcast(frame) if bytes_in(frame) <= most else frame


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
