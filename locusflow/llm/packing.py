"""Operator 6: best-fit packing by length patterns fitted with non-negative least squares.

Only the histogram of piece lengths, at most max_tokens counts, reaches the driver. There every
pattern of two or three lengths that fills a sequence exactly gets a repeat count x >= 0 with
A x near the histogram (least squares); the counts are rounded down to what is available, the fit
is repeated on the rest, and what remains is packed best fit, longest first. The plan is a list
of (pattern, repeats); pieces find their place by their rank among the pieces of their length,
which is a count a partition plus a number within it, so no group of equal lengths meets in one
task.

Null text counts as empty (the end id alone). Rows with equal or null doc_id are packed each on
its own. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .word_tokens import encoder

PIECES_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, seq long"
#: Multiplicative updates in one fit, and fits on what the last one left.
FIT_STEPS, FIT_ROUNDS = 120, 4


def cut_pieces(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most max_tokens ids; seq numbers the pieces of one length within part."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        part, numbers = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, dtype=np.int64)
        step = 4 * max_tokens
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    held = ids[at : at + step]
                    length = len(held) // 4
                    for column, value in zip(columns, (doc_id, piece, at // 4, length, zlib.crc32(held), int(numbers[length])), strict=True):
                        column.append(value)
                    numbers[length] += 1
            n = len(columns[0])
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*made[:5], pa.array(np.full(n, part, np.int32)), made[5]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"],
            )

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(cut, PIECES_SCHEMA)


def exact_patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of lengths at hand that add up to size; c is 0 in a pair."""
    have = np.zeros(size + 1, dtype=bool)
    have[present] = True
    have[0] = True
    rows = []
    for a in present[(present * 3 >= size) & (present < size)]:
        b = np.arange((size - a + 1) // 2, min(a, size - a) + 1)
        c = size - a - b
        ok = have[b] & have[c] & (b > 0)
        rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares for A x = histogram, by multiplicative updates.

    A has a column for each pattern that counts its lengths. Index 0 stands for no piece and
    carries no weight.
    """
    target = histogram.astype(float)
    target[0] = 0.0

    def spread(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(patterns[:, k], weights=x, minlength=len(target)) for k in range(3))
        y[0] = 0.0
        return y

    def gather(y: np.ndarray) -> np.ndarray:
        return y[patterns].sum(axis=1)

    aim = gather(target)
    x = np.full(len(patterns), target.sum() / max(1, 3 * len(patterns)))
    for _ in range(steps):
        x *= aim / np.maximum(gather(spread(x)), 1e-12)
    return x


def _take(patterns: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Rounded repeats, the largest first, each held down to what is left of its lengths."""
    whole = np.rint(repeats).astype(np.int64)
    taken = []
    for k in np.argsort(-repeats, kind="stable")[: int((whole > 0).sum())]:
        lengths = [int(v) for v in patterns[k] if v]
        need = {v: lengths.count(v) for v in lengths}
        n = min(int(whole[k]), *(int(left[v]) // m for v, m in need.items()))
        if n > 0:
            for v, m in need.items():
                left[v] -= m * n
            taken.append((tuple(lengths), n))
    return taken


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal sequences are filled together."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms = np.zeros(size + 1, dtype=bool)
    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):
                each = size // length
                full, rest = divmod(count, each)
                for held, n in ((each, full), (rest, 1)):
                    if held and n:
                        room = size - held * length
                        open_by_room[room].append(((length,) * held, n))
                        rooms[room] = True
                break
            room = int(fitting[0]) + length
            pattern, n = open_by_room[room].pop()
            times = room // length
            whole, rest = divmod(min(count, n * times), times)
            used = 0
            for held, m in ((times, whole), (rest, 1)):
                if held and m:
                    now = room - held * length
                    open_by_room[now].append((pattern + (length,) * held, m))
                    rooms[now] = True
                    used += m
                    count -= held * m
            if used < n:
                open_by_room[room].append((pattern, n - used))
            rooms[room] = bool(open_by_room[room])
    return [x for group in open_by_room.values() for x in group]


def plan_sequences(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) such that each length is used as often as the histogram says."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    for _ in range(FIT_ROUNDS):
        patterns = exact_patterns(np.flatnonzero(left), size)
        if not len(patterns):
            break
        taken = _take(patterns, fit_repeats(patterns, left), left)
        plan += taken
        if not taken:
            break
    return plan + best_fit(left, size)


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks by length, sorted: key (length and first rank), sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append(((length << 44) + used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pack_best_fit(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs."""
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, vocabulary, max_tokens, end_id), "pieces")
    by_part = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(max_tokens + 1, dtype=np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # max_tokens rows at most
        histogram[row.length] = row.n
    places = spark.sparkContext.broadcast(_places(plan_sequences(histogram, max_tokens)))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("seq")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            wanted = (length << 44) + batch.column("rank").to_numpy()
            k = np.searchsorted(at["key"], wanted, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(at["sequence"][k] + wanted - at["key"][k]), pa.array(at["offset"][k])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = ranked.withColumn("length", F.col("length").cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
