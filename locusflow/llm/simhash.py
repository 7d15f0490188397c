"""Operator 8: SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are made a whole text at a time. Equal fingerprints are one entry of the trie. Bits
are put in order of balance (Hamming distances don't change) and dealt to budget + 1 parts, so
that of two linked entries one part at least is the same. The self-join is made once for each
part, over a trie that has this part's bits first: down to its end the walk has no errors to
spend, beyond it the whole budget. Each of these tries is cut into subtrees of fixed size.
Subtrees that end within the first part only meet themselves; deeper ones of one head are walked
together, adding up the differing bits and leaving out each pair over the budget. A pair that is
left goes to a task, which walks on inside it in the same way, and an entry to budget + 1 tasks
however large the input is, unless more entries than a subtree holds share the whole first part.
A task returns a spanning forest of the links it finds, not each pair of a group: components are
the same. The driver sees only the counts of subtrees.

Words are runs of characters other than space and tab to carriage return, after A-Z are
lower-cased. Null and blank texts have no words and the fingerprint zero, and link as any other.
A null doc_id never names a component unless all of its group are null. Repeated rows get equal
results in the query; the stage keeps one of them. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .components import connected_components

#: Fingerprints in a subtree that one task takes whole.
SUBTREE = 16_384
#: Bits that a subtree over the size is split by at once.
SPLIT_BITS = 4
#: Node pairs held at once in a task, and pairs of entries compared directly.
FRONTIER, DIRECT = 100_000, 64
#: Shingles hashed at once; longer texts are summed up in blocks.
BLOCK = 65_536


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for first in range(0, last, BLOCK):
        hashes = [digest(b" ".join(words[i : i + width]), seed) for i in range(first, min(last, first + BLOCK))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(made.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return wanted.mapInArrow(make, "doc_id long, text_hash long, fp long")


def reorder_bits(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Put bit order[0] (counted from the highest) first, and so on."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.packbits(bits[:, order], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def _edge(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the entries lo..hi, equal in their first depth bits, turn from bit 0 to bit 1."""
    down = (64 - depth).astype(np.uint64)
    head = np.where(depth == 0, np.uint64(0), (values[lo] >> np.minimum(down, np.uint64(63))) << np.minimum(down, np.uint64(63)))
    turn = head | (np.uint64(1) << (63 - depth).astype(np.uint64))
    return np.clip(np.searchsorted(values, turn), lo, hi)


def walk_pairs(x: np.ndarray, y: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with at most budget differing bits between x[i] and y[j], both sorted.

    Both tries are walked together a bit at a time from the root. A stack of parts of the frontier
    keeps the memory bounded.
    """
    if not len(x) or not len(y):
        return
    one = np.ones(1, dtype=np.int64)
    stack = [(0 * one, len(x) * one, 0 * one, len(y) * one, 0 * one, 0 * one)]
    while stack:
        node = stack.pop()
        if len(node[0]) > FRONTIER:
            half = len(node[0]) // 2
            stack += [tuple(c[:half] for c in node), tuple(c[half:] for c in node)]
            continue
        xlo, xhi, ylo, yhi, errors, depth = node
        area = (xhi - xlo) * (yhi - ylo)
        done = (area <= DIRECT) | (depth >= 64)
        if done.any():
            a, w, b, h = xlo[done], (xhi - xlo)[done], ylo[done], (yhi - ylo)[done]
            for part in np.array_split(np.arange(len(a)), 1 + int((w * h).sum()) // (8 * FRONTIER)):
                size = w[part] * h[part]
                at = np.repeat(np.cumsum(size) - size, size)
                k = np.arange(int(size.sum())) - at
                tall = np.repeat(h[part], size)
                i, j = np.repeat(a[part], size) + k // tall, np.repeat(b[part], size) + k % tall
                near = np.bitwise_count(x[i] ^ y[j]) <= budget
                yield i[near], j[near]
        go = ~done
        if go.any():
            xlo, xhi, ylo, yhi, errors, depth = (c[go] for c in node)
            xm, ym = _edge(x, xlo, xhi, depth), _edge(y, ylo, yhi, depth)
            parts = []
            for xa, xb, ya, yb, more in ((xlo, xm, ylo, ym, 0), (xm, xhi, ym, yhi, 0), (xlo, xm, ym, yhi, 1), (xm, xhi, ylo, ym, 1)):
                keep = (xa < xb) & (ya < yb) & (errors + more <= budget)
                parts.append(tuple(c[keep] for c in (xa, xb, ya, yb, errors + more, depth + 1)))
            stack.append(tuple(np.concatenate(c) for c in zip(*parts, strict=True)))


class Forest:
    """Union-find that keeps the links which joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def near_forest(x: np.ndarray, y: np.ndarray, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of values, of the pairs within budget of x and y."""
    forest = Forest(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    for i, j in walk_pairs(x, y, budget):
        if same:
            i, j = i[i < j], j[i < j]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            forest.join(a, b + shift)
    pairs = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
    every = x if same else np.concatenate([x, y])
    return every[pairs[:, 0]], every[pairs[:, 1]]


def part_orders(balance: np.ndarray, budget: int) -> list[np.ndarray]:
    """For each of budget + 1 tries the order of its bits: those of its own part first.

    balance: each bit's distance from being set in half of the entries. The most even bits are
    dealt round, so that every part begins with even ones.
    """
    even = np.argsort(balance, kind="stable")
    parts = [even[p :: budget + 1] for p in range(budget + 1)]
    return [np.concatenate([own, even[~np.isin(even, own)]]) for own in parts]


def _subtrees(keys: DataFrame, total: int, subtree: int) -> list[tuple[int, int, int]]:
    """(part, prefix, depth) of subtrees that hold every key, split where over the size."""
    spark = keys.sparkSession
    depth = max(0, math.ceil(math.log2(max(1, total / subtree))))
    leaves, heavy = [], None
    while depth < 64:
        prefix = F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")
        found = keys
        if heavy is not None:
            head = F.shiftrightunsigned(F.col("key"), 64 - depth + SPLIT_BITS) if depth > SPLIT_BITS else F.lit(0).cast("long")
            found = keys.withColumn("head", head).join(F.broadcast(heavy), ["part", "head"])
        counts = found.groupBy("part", prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # in proportion to input / subtree
        leaves += [(r.part, r.p, depth) for r in counts if r.n <= subtree]
        more = [(r.part, r.p) for r in counts if r.n > subtree]
        if not more:
            return leaves
        heavy = spark.createDataFrame(more, "part int, head long")
        depth += SPLIT_BITS
    return leaves + [(p, h, depth - SPLIT_BITS) for p, h in more]


def _subtree_pairs(leaves: list[tuple[int, int, int]], budget: int, sizes: list[int]) -> list[tuple[int, int]]:
    """Numbers (a <= b) of subtrees of one trie that agree in its part and differ in at most budget places beyond."""
    pairs = [(k, k) for k in range(len(leaves))]
    heads: dict[tuple[int, int], list[int]] = {}
    for k, (part, prefix, depth) in enumerate(leaves):
        if depth > sizes[part]:
            heads.setdefault((part, prefix >> (depth - sizes[part])), []).append(k)
    for same in heads.values():
        prefix = np.array([leaves[k][1] for k in same], dtype=np.uint64)
        depth = np.array([leaves[k][2] for k in same], dtype=np.uint64)
        for a in range(len(same)):
            shared = np.minimum(depth[a], depth[a + 1 :])
            differing = (prefix[a] >> (depth[a] - shared)) ^ (prefix[a + 1 :] >> (depth[a + 1 :] - shared))
            pairs += [(same[a], same[a + 1 + int(k)]) for k in np.flatnonzero(np.bitwise_count(differing) <= budget)]
    return pairs


def _ordered(entries: DataFrame, budget: int) -> tuple[DataFrame, list[np.ndarray]]:
    """part, fp and key, the bits of fp in the part's order, for each entry and part; and the orders."""
    means = entries.agg(*[F.avg(F.shiftrightunsigned(F.col("fp"), 63 - b).bitwiseAND(F.lit(1)).cast("double")).alias(f"b{b}") for b in range(64)]).first()
    orders = part_orders(np.array([abs((v if v is not None else 0.5) - 0.5) for v in means]), budget)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for part, order in enumerate(orders if len(values) else ()):
                numbers = np.full(len(values), part, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column("fp"), pa.array(reorder_bits(values, order).view(np.int64))], ["part", "fp", "key"])

    return entries.select("fp").mapInArrow(turn, "part int, fp long, key long"), orders


def dealt_entries(entries: DataFrame, budget: int = 3, subtree: int = SUBTREE) -> tuple[DataFrame, Broadcast]:
    """pair (of subtrees), leaf, fp and key of each entry; leaves, pairs and orders, sent to all."""
    keys, orders = _ordered(entries, budget)
    keys = materialise(keys, "tries")
    total = entries.count()
    leaves = sorted(_subtrees(keys, total, subtree), key=lambda leaf: (leaf[0], leaf[1] << (64 - leaf[2])))
    pairs = _subtree_pairs(leaves, budget, [len(range(p, 64, budget + 1)) for p in range(budget + 1)])
    partners: list[list[int]] = [[] for _ in leaves]
    for number, (a, b) in enumerate(pairs):
        partners[a].append(number)
        if a != b:
            partners[b].append(number)
    first = [sum(leaf[0] < p for leaf in leaves) for p in range(budget + 2)]
    starts = np.array([p << (64 - d) for _, p, d in leaves], dtype=np.uint64)
    bounded = entries.sparkSession.sparkContext.broadcast((starts, first, [np.array(p, dtype=np.int32) for p in partners], np.array(pairs, dtype=np.int32).reshape(-1, 2), orders))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, at_part, of, _, _ = bounded.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                held = batch.slice(at, 2000)
                parts, key = held.column("part").to_numpy(), held.column("key").to_numpy().view(np.uint64)
                leaf = np.empty(len(key), np.int64)
                for p in np.unique(parts):
                    own = parts == p
                    leaf[own] = at_part[p] + np.searchsorted(begin[at_part[p] : at_part[p + 1]], key[own], side="right") - 1
                lists = [of[k] for k in leaf]
                times = [len(v) for v in lists]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists)), pa.array(np.repeat(leaf.astype(np.int32), times)), pa.array(np.repeat(held.column("fp").to_numpy(), times)), pa.array(np.repeat(key.view(np.int64), times))],
                    ["pair", "leaf", "fp", "key"],
                )

    return keys.mapInArrow(deal, "pair int, leaf int, fp long, key long"), bounded


def hamming_links(entries: DataFrame, budget: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp; a spanning forest of each pair of subtrees."""
    dealt, bounded = dealt_entries(entries, budget, subtree)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        _, at_part, _, both, orders = bounded.value
        a, b = both[int(group["pair"].iloc[0])]
        keys, leaf = group["key"].to_numpy().view(np.uint64), group["leaf"].to_numpy()
        x = np.sort(keys[leaf == a])
        u, v = near_forest(x, x, budget, True) if a == b else near_forest(x, np.sort(keys[leaf == b]), budget, False)
        back = np.argsort(orders[int(np.searchsorted(at_part, a, side="right")) - 1])
        ends = [reorder_bits(e, back).view(np.int64) if len(e) else np.zeros(0, np.int64) for e in (u, v)]
        return pd.DataFrame({"u": ends[0], "v": ends[1]})

    return dealt.select("pair", "leaf", "key").groupBy("pair").applyInPandas(meet, "u long, v long")


def _classes(made: DataFrame, budget: int, subtree: int) -> DataFrame:
    """fp and component for each distinct fingerprint of a stored table."""
    entries = materialise(made.select("fp").distinct(), "entries")
    found = connected_components(hamming_links(entries, budget, subtree))
    return materialise(entries.join(found, entries.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component")), "classes")


def simhash_components(docs: DataFrame, budget: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the least doc_id of the linked documents."""
    made = materialise(fingerprints(docs), "fingerprints")
    reps = made.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(_classes(made, budget, subtree), "fp")
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reps.join(least, "component").select("fp", "component_id")
    return made.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, budget: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """One row of each component, the first by doc_id, then by text hash; all columns stay.

    A row is known by doc_id and text: of rows that share both one stays, and rows that share
    doc_id alone are told apart. Rows without a doc_id come last, so one of them stays only where
    a component has no other.
    """
    made = materialise(fingerprints(docs), "fingerprints")
    rows = made.groupBy("doc_id", "text_hash", "fp").agg(F.count(F.lit(1)).alias("n")).join(_classes(made, budget, subtree), "fp")
    rows = materialise(rows.select(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash").alias("row"), "n", "component"), "rows")
    first = rows.groupBy("component").agg(F.min("row").alias("first"))
    named = rows.join(first, "component").select(F.col("row.doc_id").alias("gone_id"), F.col("row.text_hash").alias("gone_hash"), (F.col("row") == F.col("first")).alias("stays"), "n")
    marked = materialise(named.where("not stays or n > 1"), "marked")

    def same(other: DataFrame):
        return docs["doc_id"].cast("long").eqNullSafe(other["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == other["gone_hash"])

    left = docs.join(marked, same(marked), "left_anti")
    repeated = marked.where("stays")
    if repeated.isEmpty():
        return left
    return left.unionByName(docs.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
