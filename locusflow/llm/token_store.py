"""Operator 4: token ids in Parquet files that can be read a row group, page or column at a time.

A store is a folder of Parquet files in ascending doc_id order. Each row holds a document's ids
as a list column; the vocabulary fits a dictionary page, so ids are stored as packed dictionary
indexes (pass encoding="delta" for DELTA_BINARY_PACKED instead). Row groups are small and pages
are cut by rows, so that the column and offset indexes of the files let a reader of few
documents, or of the metadata columns alone, skip the rest.

Columns: doc_id, file_no (files in order), first_in_file (ids before the document in its file),
n_tokens (end id included), token_ids.

Null text counts as empty and becomes the end id alone. Rows with a null doc_id come first.
Rows with equal doc_id follow each other in the order of a digest of their texts. An empty table gives an
empty store. Further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, ship_package
from .word_tokens import encoder, id_lists

STORE_SCHEMA = "doc_id long, file_no int, first_in_file long, n_tokens int, token_ids array<int>"
ROW_GROUP_BYTES = 16 * 1024 * 1024
ROWS_A_PAGE = 1000
#: The starts of so many files are broadcast; those of more are joined by shuffle.
BROADCAST_FILES = 100_000


def write_token_store(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 2,
    encoding: str = "dictionary",
    files: int | None = None,
) -> None:
    """Tokenise every whole text and write the ids to path in ascending doc_id order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")
    spark = docs.sparkSession
    ship_package(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        file_no, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [words.encode(text) + end for text in batch.column("text").to_pylist()]
            counts = np.array([len(b) // 4 for b in ids], dtype=np.int32)
            first = seen + np.cumsum(counts, dtype=np.int64) - counts
            seen += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ids), file_no, np.int32)), pa.array(first), pa.array(counts), id_lists(ids)],
                ["doc_id", "file_no", "first_in_file", "n_tokens", "token_ids"],
            )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row_no"))
        .repartitionByRange(files, "doc_id", "digest", "row_no")  # rows of one id, or without one, may be many; the sample of keys holds no texts
        .sortWithinPartitions("doc_id", "digest", "row_no")
        .drop("digest", "row_no")
    )
    (
        ordered.mapInArrow(encode, STORE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.row.count.limit", ROWS_A_PAGE)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .parquet(path)
    )


def read_token_store(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The store's rows with start, the ids of all documents before each.

    Files are numbered in doc_id order, so start is the sum of the files before plus
    first_in_file; the sums come from the narrow n_tokens column, one row a file.
    """
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = store.groupBy("file_no").agg(F.sum("n_tokens").alias("held"))
    starts = files.select(F.col("file_no").alias("of_file"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    if len(store.inputFiles()) <= BROADCAST_FILES:  # one row a file
        starts = F.broadcast(starts)
    wanted = columns or ["doc_id", "n_tokens", "token_ids"]
    return store.join(starts, store.file_no == starts.of_file).select(
        *[c for c in wanted if c != "start"], (F.col("ahead") + F.col("first_in_file")).alias("start")
    )


def slice_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents first..last by id: statistics and page indexes prune what is read."""
    return spark.read.schema(STORE_SCHEMA).parquet(path).where(F.col("doc_id").between(first, last))


def id_checksums(lists: pa.ListArray) -> np.ndarray:
    """Unsigned CRC-32 of each list's ids as little-endian unsigned 32-bit integers."""
    offsets = lists.offsets.to_numpy()
    held = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    view = memoryview(np.ascontiguousarray(held)).cast("B")
    return np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)


def stored_checksums(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the rows of read_token_store."""
    ship_package(store.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = id_checksums(batch.column("token_ids"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums)],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = store.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "token_ids")
    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_output(docs: DataFrame, vocabulary: str, path: str | None = None, **options) -> DataFrame:
    """Write docs to a token store and return what reading it back gives, one row a document."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-store")
    write_token_store(docs, path, vocabulary, **options)
    return stored_checksums(read_token_store(spark, path))
