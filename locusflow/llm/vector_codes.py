"""Operator 12: vector codes from codebooks that delta-maintained Lloyd rounds fit.

Vectors are floored to integers and cut into equal consecutive parts; each position among the
parts has a codebook, and a vector's code is the number of the nearest entry at each position.

Pages of packed vectors are stored once, in a table bucketed by page. A round assigns the parts of
each page, compares that with the assignment the round before has stored under the same buckets
(so neither side is shuffled), and stores the new one. Each task adds up, for the parts whose entry
changed, plus one vector at the new entry and minus one at the old; only these sums are shuffled
and added to the running integer sums, which are as large as the codebooks. Entries become
floor(sum / count) componentwise; unused ones stay. All arithmetic is on integers, so results
don't depend on how rows are dealt.

Rows take part if their vector is whole and finite (nulls in the vector, the row's vector null or
empty: out) and has the most common length among those that the number of parts divides, the least
among equals. Rows without an id or a label take part; null labels are one label. A codebook begins
with the parts of the rows that come first by id, rows without an id last, equal ids by vector;
repeated rows each count. With fewer rows than entries there are as many entries as rows. An empty
table gives no rows; further columns are ignored. Components so large that squared distances
don't fit in a long are an error.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, scratch_path, ship_package, shuffles_end_with_queries, small
from .vectors import Shape, common_shape, floored_rows, matrix, packed, task_numbers

RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
#: Vectors of a page.
PAGE = 1_024
MADE = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x components, integers."""

    entries: np.ndarray
    shape: Shape

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (the lowest among equals) and squared distance of each row's parts: rows x parts."""
        kind = self.shape.numbers(4 * self.width)
        codes, errors = [], []
        for at, entries in enumerate(self.entries.astype(kind)):
            part = x[:, at * self.width : (at + 1) * self.width].astype(kind)
            # |x|^2 is the same for all entries and is left out of the comparison
            d = (entries * entries).sum(axis=1) - 2 * (part @ entries.T)
            best = d.argmin(axis=1)
            codes.append(best.astype(np.uint8))
            errors.append((d[np.arange(len(d)), best] + (part * part).sum(axis=1)).astype(np.int64))
        return np.stack(codes, axis=1), np.stack(errors, axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class RunningSums:
    """Counts and sums of the parts at each entry, changed by plus and minus contributions."""

    def __init__(self, books: Codebooks) -> None:
        self.n = np.zeros(books.entries.shape[:2], np.int64)
        self.sums = np.zeros(books.entries.shape, np.int64)

    def add(self, part: int, entry: int, n: int, sums: list[int]) -> None:
        self.n[part, entry] += n
        self.sums[part, entry] += np.array(sums, np.int64)

    def entries(self, before: np.ndarray) -> np.ndarray:
        used = self.n[:, :, None] > 0
        return np.where(used, np.floor_divide(self.sums, np.maximum(self.n, 1)[:, :, None]), before)


def changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, sums: RunningSums) -> None:
    """Add plus one at the new entry and minus one at the old one for the parts that moved."""
    width = sums.sums.shape[2]
    for part in range(after.shape[1]):
        moved = np.arange(len(x)) if before is None else np.flatnonzero(before[:, part] != after[:, part])
        own = x[moved, part * width : (part + 1) * width].astype(np.int64)
        for codes, sign in ((after, 1), (before, -1)):
            if codes is not None:
                np.add.at(sums.n[part], codes[moved, part], sign)
                np.add.at(sums.sums[part], codes[moved, part], sign * own)


def _save(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """frame as a table bucketed by page, and its name."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    name = os.path.basename(path).replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_end_with_queries(spark):
        frame.write.bucketBy(buckets, "page").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), name


def _drop(table: DataFrame, name: str) -> None:
    discard(table)
    table.sparkSession.sql(f"DROP TABLE {name}")


def pages_of(rows: DataFrame) -> DataFrame:
    """page, ids, labels, vecs: up to PAGE packed rows each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = task_numbers()
        for whole in batches:
            for at in range(0, whole.num_rows, PAGE):
                batch = whole.slice(at, PAGE)
                lists = [pa.array([batch.column(c).to_pylist()], pa.list_(k)) for c, k in (("vec_id", pa.int64()), ("label", pa.string()))]
                vecs = pa.array([b"".join(batch.column("x").to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *lists, vecs], ["page", "ids", "labels", "vecs"])

    return rows.mapInArrow(gather, "page long, ids array<long>, labels array<string>, vecs binary")


def assign(pages: DataFrame, books: Codebooks, before: DataFrame | None) -> DataFrame:
    """page, codes, and with a task's last page what its changes add up to."""
    shape = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, last = RunningSums(books), None
        for batch in batches:
            held = zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True)
            for page, vecs, *old in held:
                x = matrix(vecs, shape)
                codes, _ = books.nearest(x)
                changes(x, np.frombuffer(old[0], np.uint8).reshape(codes.shape) if old else None, codes, sums)
                if last is not None:
                    yield stored(*last, [])
                last = page, codes.tobytes()
        if last is not None:
            at = np.argwhere((sums.n != 0) | (sums.sums != 0).any(axis=2))
            yield stored(*last, [{"part": int(p), "entry": int(e), "n": int(sums.n[p, e]), "sums": sums.sums[p, e].tolist()} for p, e in at])

    def stored(page: int, codes: bytes, made: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([codes], pa.binary()), pa.array([made], pa.list_(MADE))], ["page", "codes", "made"])

    held = pages.select("page", "vecs")
    if before is not None:
        held = held.join(before.select("page", "codes").hint("shuffle_hash"), "page")
    return held.mapInArrow(work, "page long, codes binary, made array<struct<part: int, entry: int, n: long, sums: array<long>>>")


def _added_up(assigned: DataFrame, books: Codebooks) -> list:
    """part, entry, n and sums over all tasks: at most a row an entry."""
    made = assigned.select(F.explode("made").alias("m")).select("m.part", "m.entry", "m.n", "m.sums")
    each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(books.width)]
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()


def fit(pages: DataFrame, books: Codebooks, rounds: int) -> Codebooks:
    """Codebooks after so many rounds, each of which shuffles what has changed since the one before."""
    sums, before, name = RunningSums(books), None, ""
    for turn in range(rounds):
        after, after_name = _save(assign(pages, books, before), f"assigned-{turn}")
        for row in _added_up(after, books):
            sums.add(row.part, row.entry, row.n, list(row[3:]))
        if before is not None:
            _drop(before, name)
        before, name = after, after_name
        books = Codebooks(sums.entries(books.entries), books.shape)
    if before is not None:
        _drop(before, name)
    return books


def _coded(pages: DataFrame, books: Codebooks) -> DataFrame:
    shape = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, vecs in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "vecs")), strict=True):
                codes, errors = books.nearest(matrix(vecs, shape))
                digits = [r.tobytes().hex() for r in codes]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(digits), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return pages.select("ids", "labels", "vecs").mapInArrow(work, "vec_id long, label string, code string, error long")


def compress(
    embeddings: DataFrame, factor: int = 1_024, parts: int = 4, entries: int = 256, rounds: int = 4,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (error over the row's label), codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits number at most 256 entries")
    spark: SparkSession = embeddings.sparkSession
    ship_package(spark)
    rows = floored_rows(embeddings, factor, id_column, vector_column, label_column)
    shape = common_shape(rows, parts)
    if shape is None:
        return spark.createDataFrame([], RESULT)
    width = shape.length // parts
    shape.numbers(4 * shape.length)  # raises if errors could pass a long
    first = rows.where(F.size("x") == shape.length).orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    books = Codebooks(np.array([r.x for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2), shape)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages, name = _save(pages_of(packed(rows, shape, ["vec_id", "label"])).repartition(buckets, "page"), "vector-pages")
    books = fit(pages, books, rounds)
    coded = materialise(_coded(pages, books), "vector-codes")
    _drop(pages, name)
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "l")
    found = coded.join(small(sums), F.col("label").eqNullSafe(F.col("l")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
