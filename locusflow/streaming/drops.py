"""Per-variant statistics over a folder of native Parquet drops, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..frame import VariantFrame


def process_drops(
    spark: SparkSession, folder: str, out: str, checkpoint: str, samples, ploidy: int, function: Callable[[VariantFrame], DataFrame], schema=None
) -> int:
    """Apply a narrow function to the files that came since the last call; returns the rows written.

    Trigger.AvailableNow takes what is there and stops; the checkpoint remembers the files, and
    the Parquet sink commits a batch once.
    """
    schema = schema or spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).parquet(folder)
    made = function(VariantFrame(stream, samples, ploidy))
    query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
