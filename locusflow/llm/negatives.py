"""Operator 11: hard negatives by one-dimensional distance keys.

Vectors are floored to integers and lengthened by one component to a common length, which turns
the largest inner product into the least distance. A bounded sample gives pivots; each vector's
key is (nearest pivot, distance to it), and the vectors are stored in pages sorted by it. A vector
at distance d from the query lies, under a pivot at distance p from the query, within the key
interval p - d to p + d, and none of key k is nearer than |p - k| or farther than p + k.

A search asks for the first rows of a score window. Chunks of queries that are neighbours in key
order walk together, in rounds: the interval of every pivot, from the window's inner distance out
to the round's radius, is joined with the pages' own intervals, and each page found is compared
with the chunk by one matrix product. A query has its answer when the radius reaches the distance
of the last row that it holds: no page left can have a better one. The last round's radius covers
whatever is not certified by then, so results are exact.

Positives are searched first (the same label, any score), then negatives (other labels, one window
for each positive). Scores are exact integers: inner products of floored components.

Rows take part if label and id are known and the vector is whole and finite, of the most common
length (the least among equals). Repeated rows are rows of their own: an anchor is never its own
positive, but a row that repeats it is one. A label with one row gives its anchor no positives
and so no rows; a positive of negative score has no negatives. Ties go to the smaller id. An empty table
gives no rows; further columns are ignored. Components so large that a hundred times a score
doesn't fit in a long are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, ship_package
from .vectors import Shape, common_shape, floored_rows, matrix, packed, task_numbers

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PAGE_SCHEMA = "page long, pivot int, low double, high double, uids array<long>, ids array<long>, labels array<string>, vecs binary"
#: Windows of scores are within these when they have no end.
LEAST, MOST = -(2**62), 2**62


@dataclass(frozen=True)
class KeySettings:
    """pivots, fitted on sample rows by hash of the row; page, chunk: vectors and queries of a row of
    the index; radii: of the rounds before the last, as shares of the common length beyond the nearest data."""

    pivots: int = 64
    sample: int = 4_096
    turns: int = 8
    page: int = 1_024
    chunk: int = 256
    radii: tuple[float, ...] = (0.125, 0.5)


@dataclass(frozen=True)
class Pivots:
    """centers, in lengthened space; squared is the common length's square."""

    centers: np.ndarray
    squared: int
    shape: Shape

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.sqrt(np.maximum(self.squared - (x * x).sum(axis=1), 0.0))
        return np.concatenate([x, more[:, None]], axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] + (self.centers**2).sum(axis=1)[None, :] - 2 * (x @ self.centers.T)
        return np.sqrt(np.maximum(d, 0.0))

    def of_queries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries brought to the common length, which leaves their order of scores as it is, and their own lengths."""
        x = x.astype(np.float64)
        norms = np.sqrt((x * x).sum(axis=1))
        unit = x / np.where(norms > 0, norms, 1)[:, None] * math.sqrt(self.squared)
        return np.concatenate([unit, np.zeros((len(x), 1))], axis=1), norms

    def radius(self, score: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The distance at which a score lies; all of the space where it is below every score."""
        common = math.sqrt(self.squared)
        squared = 2 * self.squared - 2 * common * score / np.where(norms > 0, norms, 1)
        far = np.where(norms > 0, np.sqrt(np.clip(squared, 0, 4 * self.squared)), np.where(score > 0, 0.0, 2 * common))
        return far


def fit_pivots(rows: DataFrame, shape: Shape, s: KeySettings) -> Pivots:
    """Centres of a bounded sample of stored rows, by a few rounds of means; they decide on speed alone."""
    squared = rows.agg(F.max("squared").alias("m")).first().m
    held = rows.orderBy(F.xxhash64("uid"), "uid").limit(s.sample).select("x").collect()
    x = Pivots(np.zeros((0, shape.length + 1)), squared, shape).lengthened(matrix(b"".join(bytes(r.x) for r in held), shape))
    centers = np.unique(x, axis=0)
    centers = centers[np.random.default_rng(5).permutation(len(centers))[: s.pivots]]
    for _ in range(s.turns):
        own = Pivots(centers, squared, shape).distances(x).argmin(axis=1)
        centers = np.array([x[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centers)])
    return Pivots(centers, squared, shape)


def stored_rows(rows: DataFrame, shape: Shape, is_query: Column) -> DataFrame:
    """uid, vec_id, label, x (packed), squared (length) and is_query of the rows that take part."""
    squared = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v * v)
    held = rows.where(F.size("x") == shape.length).select("vec_id", "label", "x", squared.alias("squared"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    held = packed(held, shape, ["vec_id", "label", "squared", "is_query"])
    return materialise(held.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def sorted_pages(rows: DataFrame, pivots: Pivots, most: int, label: str, one_pivot: bool = True) -> DataFrame:
    """Pages of up to most rows in order of (pivot, distance), of one pivot each unless that doesn't matter, with the distances they begin and end at."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = pivots.distances(pivots.lengthened(matrix(b"".join(batch.column("x").to_pylist()), pivots.shape)))
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own]), *batch.columns], ["pivot", "distance", *batch.schema.names])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = task_numbers()
        for batch in batches:
            own, d = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy()
            starts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) & one_pivot)) if len(own) else []
            for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
                for at in range(a, b, most):
                    end = min(at + most, b)
                    page = batch.slice(at, end - at)
                    lists = [pa.array([page.column(c).to_pylist()], pa.list_(k)) for c, k in (("uid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.string()))]
                    head = [pa.array([next(numbers)], pa.int64()), pa.array([own[at]], pa.int32()), pa.array([d[at]]), pa.array([d[end - 1]])]
                    yield pa.RecordBatch.from_arrays([*head, *lists, pa.array([b"".join(page.column("x").to_pylist())], pa.binary())], [c.split()[0] for c in PAGE_SCHEMA.split(", ")])

    keyed = rows.select("uid", "vec_id", "label", "x").mapInArrow(key, "pivot int, distance double, uid long, vec_id long, label string, x binary")
    in_order = keyed.repartitionByRange("pivot", "distance", "uid").sortWithinPartitions("pivot", "distance", "uid")
    return materialise(in_order.mapInArrow(gather, PAGE_SCHEMA), label)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query's windows."""
    once = found.groupBy("query", "window", "uid").agg(F.first("chunk").alias("chunk"), F.first("score").alias("score"), F.first("vec_id").alias("vec_id"))
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id", "uid")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("chunk", "query", "window", "uid", "score", "vec_id", "r")


FOUND = "chunk long, query long, window int, uid long, score long, vec_id long, r int"


def _intervals(chunks: DataFrame, pivots: Pivots, reach: DataFrame, radius: float, before: float | None) -> DataFrame:
    """chunk, pivot and the key interval that the chunk's open queries need, and the one that earlier rounds have read.

    A query is open if its last row may not be certain within the radius of the round before.
    """
    ends = {r.pivot: (r.low, r.high) for r in reach.collect()}  # a row a pivot
    low, high = (np.array([ends.get(k, (math.inf, -math.inf))[e] for k in range(len(pivots.centers))]) for e in (0, 1))
    common = math.sqrt(pivots.squared)
    slack = 1e-6 * common + 1e-9

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for chunk, uids, vecs, asks in zip(*(batch.column(c).to_pylist() for c in ("chunk", "uids", "vecs", "asks")), strict=True):
                x, norms = pivots.of_queries(matrix(vecs, pivots.shape))
                at = {u: i for i, u in enumerate(uids)}
                sure, inner = np.zeros(len(x)), np.full(len(x), 2 * common)
                held = np.array([at[a["query"]] for a in asks])
                bar, top = (np.array([float(a[c]) for a in asks]) for c in ("bar", "high"))
                np.maximum.at(sure, held, pivots.radius(bar, norms[held]))
                np.minimum.at(inner, held, np.where((top >= MOST) | (norms[held] == 0), 0.0, pivots.radius(top, norms[held])))
                d = pivots.distances(x)
                nearest = np.maximum(np.maximum(low[None, :] - d, d - high[None, :]), 0).min(axis=1)
                reached = None if before is None else np.minimum(sure, nearest + before * common)
                open_ = np.isin(np.arange(len(x)), held) & (True if reached is None else reached < sure)
                if not open_.any():
                    continue
                d, inner = d[open_], inner[open_, None] - slack
                now = np.minimum(sure, nearest + radius * common)[open_, None] + slack
                from_, to = np.maximum(d - now, inner - d).min(axis=0), (d + now).max(axis=0)
                if reached is None:
                    was_from, was_to = np.full(len(from_), math.inf), np.full(len(from_), -math.inf)
                else:
                    was = reached[open_, None] + slack
                    was_from, was_to = np.maximum(d - was, inner - d).min(axis=0), (d + was).max(axis=0)
                for k in np.flatnonzero((to >= low) & (from_ <= high)):
                    for column, value in zip(out, (chunk, k, from_[k], to[k], was_from[k], was_to[k]), strict=True):
                        column.append(value)
            kinds = [np.int64, np.int32, *[np.float64] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, k)) for c, k in zip(out, kinds, strict=True)], ["chunk", "pivot", "from_", "to_", "was_from", "was_to"])

    return chunks.mapInArrow(work, "chunk long, pivot int, from_ double, to_ double, was_from double, was_to double")


def _compare(met: DataFrame, shape: Shape, k: int, same_label: bool) -> DataFrame:
    """For each page and chunk that meet, the first k rows of each query's windows."""
    kind = shape.numbers(shape.length)
    names = [c.split()[0] for c in FOUND.split(", ")]

    def one(chunk: int, asks: list, qvecs: bytes, vecs: bytes, quids: np.ndarray, uids: np.ndarray, ids: np.ndarray, equal: np.ndarray) -> list[np.ndarray]:
        scores = np.rint(matrix(qvecs, shape).astype(kind) @ matrix(vecs, shape).astype(kind).T).astype(np.int64)
        allowed = (equal == same_label) & (quids[:, None] != uids[None, :])
        at = {u: i for i, u in enumerate(quids.tolist())}
        rows = np.array([at[a["query"]] for a in asks])
        window, bar, high = (np.array([a[c] for a in asks], np.int64) for c in ("window", "bar", "high"))
        parts = []
        for w in np.unique(window):
            own = np.flatnonzero(window == w)
            held = scores[rows[own]]
            q, v = np.nonzero(allowed[rows[own]] & (held >= bar[own, None]) & (held <= high[own, None]))
            s = held[q, v]
            order = np.lexsort((uids[v], ids[v], -s, q))
            q, v, s = q[order], v[order], s[order]
            first = np.searchsorted(q, q)  # where the query's rows begin
            kept = np.arange(len(q)) - first < k
            q, v, s = q[kept], v[kept], s[kept]
            parts.append([np.full(len(q), chunk), quids[rows[own][q]], np.full(len(q), w), uids[v], s, ids[v], np.zeros(len(q))])
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                plain = [batch.column(c)[at].as_py() for c in ("chunk", "asks", "qvecs", "vecs")]
                quids, uids, ids, qlabels, labels = (batch.column(c)[at].values for c in ("quids", "uids", "ids", "qlabels", "labels"))
                codes = pa.concat_arrays([qlabels, labels]).dictionary_encode().indices.to_numpy()
                equal = codes[: len(quids), None] == codes[None, len(quids) :]
                made = one(*plain, *(c.to_numpy() for c in (quids, uids, ids)), equal)
                kinds = [np.int64, np.int64, np.int32, np.int64, np.int64, np.int64, np.int32]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(made, kinds, strict=True)], names)

    return met.select("chunk", "asks", "qvecs", "vecs", "quids", "uids", "ids", "qlabels", "labels").mapInArrow(work, FOUND)


def search(pages: DataFrame, queries: DataFrame, asks: DataFrame, pivots: Pivots, k: int, same_label: bool, s: KeySettings = KeySettings()) -> DataFrame:
    """query, window, uid, score, vec_id, r: the first k rows of each ask by score, then id.

    pages and queries are sorted_pages; asks has chunk, query, window and the scores low and high
    that its rows lie between, ends included. Rows have the query's label, or another.
    """
    asks = materialise(asks, "asks")
    reach = pages.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    side = queries.select(F.col("page").alias("chunk"), F.col("uids").alias("quids"), F.col("labels").alias("qlabels"), F.col("vecs").alias("qvecs"))
    held, before = queries.sparkSession.createDataFrame([], FOUND), None
    for radius in (*s.radii, 2.0):
        ends = held.where(F.col("r") == k).select("query", "window", F.col("score").alias("last"))
        barred = asks.join(ends, ["query", "window"], "left").withColumn("bar", F.greatest("low", F.coalesce("last", "low")))
        grouped = barred.groupBy("chunk").agg(F.collect_list(F.struct("query", "window", "bar", "high")).alias("asks"))  # a chunk's queries and windows
        chunks = side.join(grouped, "chunk")
        needed = _intervals(chunks.select("chunk", F.col("quids").alias("uids"), F.col("qvecs").alias("vecs"), "asks"), pivots, reach, radius, before)
        where = pages.select("page", F.col("pivot").alias("of"), "low", "high")
        read = (F.col("high") >= F.col("from_")) & (F.col("low") <= F.col("to_")) & ~((F.col("high") >= F.col("was_from")) & (F.col("low") <= F.col("was_to")))
        pairs = materialise(needed.join(where, (F.col("pivot") == F.col("of")) & read).select("chunk", "page"), "to-read")
        before = radius
        if pairs.isEmpty():
            discard(pairs)
            break
        met = pairs.join(chunks, "chunk").join(pages.select("page", "uids", "ids", "labels", "vecs"), "page")
        after = materialise(_best(held.unionByName(_compare(met, pivots.shape, k, same_label)), k), "nearest")
        discard(pairs)
        discard(held)
        held = after
    discard(asks)
    return held.select("query", "window", "uid", "score", "vec_id", "r")


def mine_hard_negatives(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100, factor: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", settings: KeySettings = KeySettings(),
) -> DataFrame:
    """For each anchor and each of its first positives, the first rows of other labels whose score is
    between two percentages of the positive's. is_anchor is a condition on vec_id."""
    spark: SparkSession = embeddings.sparkSession
    ship_package(spark)
    rows = floored_rows(embeddings, factor, id_column, vector_column, label_column).where("vec_id is not null and label is not null")
    shape = common_shape(rows)
    if shape is None:
        return spark.createDataFrame([], RESULT)
    shape.numbers(100 * shape.length)  # raises if a hundred scores could pass a long
    held = stored_rows(rows, shape, is_anchor)
    pivots = fit_pivots(held, shape, settings)
    pages = sorted_pages(held, pivots, settings.page, "pages")
    anchors = sorted_pages(held.where("is_query"), pivots, settings.chunk, "anchors", one_pivot=False)
    discard(held)
    everything = {"window": F.lit(0), "low": F.lit(LEAST), "high": F.lit(MOST)}
    asks = anchors.select(F.col("page").alias("chunk"), F.explode("uids").alias("query")).withColumns(everything)
    near = search(pages, anchors, asks, pivots, positives, True, settings)
    near = near.select("query", (F.col("r") - 1).alias("window"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))

    def share(percent: int, up: bool) -> Column:
        """percent of the positive's score as a whole number, rounded up or down."""
        n = f"positive_score * {percent}"
        return F.expr(f"({n} + pmod(-({n}), 100)) div 100" if up else f"({n} - pmod({n}, 100)) div 100")

    owner = anchors.select(F.col("page").alias("chunk"), F.explode(F.arrays_zip("uids", "ids")).alias("e")).select("chunk", F.col("e.uids").alias("query"), F.col("e.ids").alias("anchor_id"))
    windows = near.join(owner, "query").withColumns({"low": share(least_percent, True), "high": share(most_percent, False)})
    asks = windows.where("low <= high").select("chunk", "query", "window", "low", "high")
    far = search(pages, anchors, asks, pivots, negatives, False, settings)
    far = far.select("query", "window", F.col("r").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(windows, ["query", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
