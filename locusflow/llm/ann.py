"""Operator 7: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. A first graph comes from hashed blocks: random planes deal the nodes
to blocks of bounded size, several times over, and each block compares its own. NN-descent then
improves it in rounds of Spark joins: every node gathers a sample of its neighbours and of the
nodes it is a neighbour of, with their vectors, and compares them with one another; what comes
nearer than a node's last neighbour is proposed to it. Rounds end when few edges are left that
no round has compared.

Queries walk the graph both ways: a node's list holds its own neighbours and, of the nodes that
list it, the nearest and the longest, so its length is bounded. Long vectors answer many queries
but few short ones have them as neighbours; the second half of the list leads to them. All queries
walk together, a hop a join: each sends its vector to its best open nodes, whose lists stand with
packed vectors in a table bucketed by node; what is nearer than the end of the query's pool comes
back. Hops end when no pool has an open node. The pool's best are scored again in double precision
on the original vectors, and nodes are replaced by their members.

Nearness is the inner product. Vectors of different length are brought to one by an added
component for the graph, which turns the largest product into the least distance; queries have
zero there. What the added component falls short of the common length is kept, as a float of its
own, so that one very long vector takes no precision from the others. Compared vectors are rounded
to bytes, each by its own scale; queries and results are not. A walk starts at a sample of the
nodes and at the longest ones, which stand apart from all others in the graph.

Vectors that are null or zero, hold null or non-finite components, or aren't of the most common
length take no part, nor do rows without an id. Repeated rows are members of their own. With
fewer candidates than asked for, all that the graph reaches are returned; an empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, scratch_path, ship_package, shuffles_end_with_queries

#: Bytes up to which a stored frontier is broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024
#: Rounds and hops after which a run is given up as one that doesn't settle.
MOST_TURNS = 500


@dataclass(frozen=True)
class GraphSettings:
    """degree: neighbours kept; tables, block: of the first graph; sample, proposals: of a round;
    enough: the share of edges not yet compared at which rounds end."""

    degree: int = 32
    tables: int = 12
    block: int = 2_048
    sample: int = 12
    proposals: int = 6
    enough: float = 0.05
    seed: int = 7


@dataclass(frozen=True)
class SearchSettings:
    """pool: nodes kept for a query; open: expanded in a hop; entries: common starting nodes, as many
    again of the longest; near, long: nodes that list a node and that it gets in return; hub: queries
    beyond which a node that many expand is split in parts of about as many."""

    pool: int = 256
    open: int = 64
    entries: int = 64
    near: int = 16
    long: int = 16
    hub: int = 100_000


#: Bytes of a packed vector beside its codes: the scale and the added component's shortfall.
TAIL = 8


def pack_vectors(x: np.ndarray, short: np.ndarray) -> list[bytes]:
    """Each row as signed bytes, the float that scales them back, and short, a float of its own."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    tails = np.stack([scale, short], axis=1).astype("<f4").view(np.uint8).reshape(-1, TAIL)
    return [bytes(r) for r in np.concatenate([codes.view(np.uint8), tails], axis=1)]


def unpack_vectors(joined: bytes, width: int) -> np.ndarray:
    """The rows' components and, as the last column, what pack_vectors got as short."""
    raw = np.frombuffer(joined, dtype=np.uint8).reshape(-1, width)
    tails = np.ascontiguousarray(raw[:, -TAIL:]).view("<f4")
    codes = np.ascontiguousarray(raw[:, :-TAIL]).view(np.int8).astype(np.float32)
    return np.concatenate([codes * tails[:, :1], tails[:, 1:]], axis=1)


def nearness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minus half the squared distance of unpacked rows: the product of the lengthened vectors, less their common squared length."""
    half_x, half_y = (np.einsum("ij,ij->i", z, z) / 2 for z in (x, y))
    return x @ y.T - half_x[:, None] - half_y[None, :]


def usable(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and x (array of doubles) of the rows that take part."""
    x = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < math.inf), F.lit(False)))
    rows = rows.where((F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("x") == (sizes[0].d if sizes else 0))


def nodes_and_members(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x), the least vec_id standing for equal vectors, and members (node, vec_id).

    Only the first `most` members by id can be among anyone's nearest; a rank limit keeps the rest
    from being gathered.
    """
    equal = Window.partitionBy("x").orderBy("vec_id")
    ranked = rows.withColumn("r", F.row_number().over(equal)).where(F.col("r") <= most)
    ranked = materialise(ranked.withColumn("node", F.first("vec_id").over(equal)), "members")
    return ranked.where("r = 1").select("node", "x"), ranked.select("node", "vec_id")


def packed_nodes(nodes: DataFrame) -> tuple[DataFrame, int]:
    """node, vec (packed, with the added component's shortfall), short and the width of vec."""
    ship_package(nodes.sparkSession)
    first = nodes.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("most"), F.max(F.size("x")).alias("d")).first()
    most, width = first.most or 0.0, (first.d or 0) + TAIL

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                squares = (x * x).sum(axis=1)
                # the common length less the added component, without the difference of large numbers
                short = squares / np.maximum(math.sqrt(most) + np.sqrt(np.maximum(most - squares, 0.0)), 1e-300)
                made = pack_vectors(x, short)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary()), pa.array(short)], ["node", "vec", "short"])

    return materialise(nodes.mapInArrow(pack, "node long, vec binary, short double"), "packed-nodes"), width


def _lists(ids: list[np.ndarray], sims: list[np.ndarray], extra: list[np.ndarray]) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
    held = [(ids, np.int64), (sims, np.float32), (extra, np.int8)]
    return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v).astype(t) if v else np.zeros(0, t))) for v, t in held]


def first_graph(packed: DataFrame, width: int, n: int, s: GraphSettings) -> DataFrame:
    """u, vs, sims: for each node and table the best of its block."""
    bits = max(0, math.ceil(math.log2(max(1, 2 * n / s.block))))
    planes = np.random.default_rng(s.seed).normal(size=(s.tables, width - TAIL + 1, max(1, bits)))
    middle = packed.orderBy(F.xxhash64("node"), "node").limit(1_000).collect()  # a bounded sample, to centre the planes
    mean = unpack_vectors(b"".join(bytes(r.vec) for r in middle), width).mean(axis=0) if middle else 0.0
    tables = s.tables if bits else 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack_vectors(b"".join(batch.column("vec").to_pylist()), width) - mean
            for t in range(tables):
                key = ((x @ planes[t] > 0) @ (1 << np.arange(max(1, bits)))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key), batch.column("node"), batch.column("vec")], ["t", "cell", "node", "vec"])

    dealt = packed.select("node", "vec").mapInArrow(deal, "t int, cell long, node long, vec binary")
    sizes = dealt.groupBy(F.col("t").alias("t2"), F.col("cell").alias("c2")).agg(F.ceil(F.count(F.lit(1)) / s.block).alias("parts"))
    dealt = dealt.join(sizes, (F.col("t") == F.col("t2")) & (F.col("cell") == F.col("c2")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", "t"), F.col("parts")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["node"].to_numpy()
        x = unpack_vectors(b"".join(group["vec"]), width)
        k = min(s.degree, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"u": ids, "vs": [np.zeros(0, np.int64)] * len(ids), "sims": [np.zeros(0, np.float32)] * len(ids)})
        vs, sims = [], []
        for at in range(0, len(ids), 512):
            p = nearness(x[at : at + 512], x)
            p[np.arange(len(p)), at + np.arange(len(p))] = -np.inf
            best = np.argpartition(-p, k - 1, axis=1)[:, :k]
            vs += list(ids[best])
            sims += list(np.take_along_axis(p, best, axis=1))
        return pd.DataFrame({"u": ids, "vs": vs, "sims": sims})

    return dealt.select("t", "cell", "part", "node", "vec").groupBy("t", "cell", "part").applyInPandas(compare, "u long, vs array<long>, sims array<float>")


#: States of an edge between rounds: settled, new, new and sampled for the next round, settled and sampled.
OLD, NEW, NEW_SAMPLED, OLD_SAMPLED = 0, 1, 2, 3
GRAPH_SCHEMA = "u long, vs array<long>, sims array<float>, states array<tinyint>, taken int"


def merge_lists(lists: DataFrame, s: GraphSettings, turn: int) -> DataFrame:
    """One row a node: its best neighbours from lists of (u, vs, sims, states), sampled for the next round."""
    grouped = lists.groupBy("u").agg(F.flatten(F.collect_list("vs")).alias("vs"), F.flatten(F.collect_list("sims")).alias("sims"), F.flatten(F.collect_list("states")).alias("states"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rng = np.random.default_rng([s.seed, turn, batch.column("u")[0].as_py() if batch.num_rows else 0])
            ids, sims, states, taken = [], [], [], []
            columns = [batch.column(c) for c in ("vs", "sims", "states")]
            offsets = columns[0].offsets.to_numpy()
            v, p, f = (c.values.to_numpy(zero_copy_only=False) for c in columns)
            base = [c.offsets[0].as_py() for c in columns]
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                a, b = int(a - base[0]), int(b - base[0])
                vi, pi, fi = v[base[0] + a : base[0] + b], p[base[1] + a : base[1] + b], f[base[2] + a : base[2] + b]
                order = np.lexsort((fi, vi, -pi))  # equal similarity: by node, settled first
                vi, pi, fi = vi[order], pi[order], fi[order]
                _, once = np.unique(vi, return_index=True)
                once = np.sort(once)[: s.degree]
                vi, pi = vi[once], pi[once]
                # an edge is settled if any copy of it is
                settled = np.isin(vi, v[base[0] + a : base[0] + b][f[base[2] + a : base[2] + b] == OLD])
                state = np.where(settled, OLD, NEW).astype(np.int8)
                taken.append(int((~settled).sum()))
                for held, mark in ((np.flatnonzero(~settled), NEW_SAMPLED), (np.flatnonzero(settled), OLD_SAMPLED)):
                    state[rng.permutation(held)[: s.sample]] = mark
                ids.append(vi)
                sims.append(pi)
                states.append(state)
            yield pa.RecordBatch.from_arrays([batch.column("u"), *_lists(ids, sims, states), pa.array(taken, pa.int32())], ["u", "vs", "sims", "states", "taken"])

    return grouped.mapInArrow(merge, GRAPH_SCHEMA)


def _proposals(graph: DataFrame, packed: DataFrame, width: int, s: GraphSettings, turn: int) -> DataFrame:
    """Pairs of sampled neighbours of one node that come nearer than the last neighbour of either."""
    edges = graph.select("u", F.explode(F.arrays_zip("vs", "states")).alias("e")).select("u", F.col("e.vs").alias("v"), F.col("e.states").alias("state"))
    chosen = edges.where(F.col("state") >= NEW_SAMPLED).withColumn("fresh", F.col("state") == NEW_SAMPLED)
    back = chosen.select(F.col("v").alias("center"), F.col("u").alias("member"), "fresh")
    few = Window.partitionBy("center", "fresh").orderBy(F.xxhash64("center", "member", F.lit(turn)), "member")
    back = back.withColumn("r", F.row_number().over(few)).where(F.col("r") <= s.sample).drop("r")
    met = chosen.select(F.col("u").alias("center"), F.col("v").alias("member"), "fresh").unionByName(back)
    last = graph.select(F.col("u").alias("node"), F.when(F.size("sims") >= s.degree, F.array_min("sims")).otherwise(F.lit(-math.inf)).cast("float").alias("bar"))
    known = packed.join(last, "node").select(F.col("node").alias("member"), "vec", "bar")
    held = met.join(known, "member").groupBy("center").agg(F.collect_list(F.struct("member", "fresh", "bar", "vec")).alias("met"))
    held = held.select(*[F.col(f"met.{c}").alias(c) for c in ("member", "fresh", "bar", "vec")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            rows = zip(*(batch.column(c).to_pylist() for c in ("member", "fresh", "bar", "vec")), strict=True)
            for members, fresh, bars, vecs in rows:
                ids, new = np.array(members, np.int64), np.array(fresh, bool)
                if not new.any() or len(ids) < 2:
                    continue
                x = unpack_vectors(b"".join(vecs), width)
                p = nearness(x, x)
                p[~((new[:, None] | new[None, :]) & (p > np.array(bars, np.float32)[:, None]) & (ids[:, None] != ids[None, :]))] = -np.inf
                k = min(s.proposals, len(ids))
                best = np.argpartition(-p, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(p, best, axis=1)
                i, j = np.nonzero(near > -np.inf)
                for column, value in zip(out, (ids[i], ids[best[i, j]], near[i, j]), strict=True):
                    column.append(value)
            u, v, p = (np.concatenate(c) if c else np.zeros(0) for c in out)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(p.astype(np.float32))], ["u", "v", "sim"])

    pairs = held.mapInArrow(compare, "u long, v long, sim float").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return pairs.select("u", F.array("v").alias("vs"), F.array("sim").alias("sims"), F.array(F.lit(NEW).cast("tinyint")).alias("states"))


def nn_descent(packed: DataFrame, width: int, s: GraphSettings = GraphSettings()) -> DataFrame:
    """The neighbour graph: u, vs, sims, states, taken."""
    n = packed.count()
    start = first_graph(packed, width, n, s).withColumn("states", F.transform("vs", lambda _: F.lit(NEW).cast("tinyint")))
    graph = materialise(merge_lists(start, s, 0), "graph-0")
    for turn in range(1, MOST_TURNS):
        kept = graph.select("u", "vs", "sims", F.transform("states", lambda f: F.when(f == NEW, NEW).otherwise(OLD).cast("tinyint")).alias("states"))
        after = materialise(merge_lists(kept.unionByName(_proposals(graph, packed, width, s, turn)), s, turn), f"graph-{turn}")
        fresh = after.agg(F.sum("taken").alias("n")).first().n or 0
        discard(graph)
        graph = after
        if fresh <= s.enough * n * s.degree:
            return graph
    raise RuntimeError("the neighbour graph doesn't settle")


def two_way_lists(graph: DataFrame, packed: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """u and v: a node's own neighbours and, of the nodes that list it, the nearest and then the longest."""
    edges = graph.select("u", F.explode(F.arrays_zip("vs", "sims")).alias("e")).select("u", F.col("e.vs").alias("v"), F.col("e.sims").alias("sim"))
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim").join(packed.select(F.col("node").alias("v"), "short"), "v")

    def first(order: list, most: int) -> DataFrame:
        """A rank limit of its own, which holds in each task before the rows of a node meet."""
        ranked = back.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(*order)))
        return ranked.where(F.col("r") <= most).select("u", "v")

    near, long = first([F.desc("sim"), "v"], s.near), first([F.desc("short"), "v"], s.long)
    return edges.select("u", "v").unionByName(near).unionByName(long).distinct()


def _bucketed(lists: DataFrame, packed: DataFrame, label: str) -> tuple[DataFrame, str]:
    """u, vs, vecs (their vectors, one after the other), as a table bucketed by u, so that no hop shuffles it; and its name."""
    spark = packed.sparkSession
    sides = lists.join(packed.select(F.col("node").alias("v"), "vec"), "v")
    held = sides.groupBy("u").agg(F.collect_list(F.struct("v", "vec")).alias("e"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [b"".join(v) for v in batch.column("vecs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("vs"), pa.array(vecs, pa.binary())], ["u", "vs", "vecs"])

    made = held.select("u", F.col("e.v").alias("vs"), F.col("e.vec").alias("vecs")).mapInArrow(join, "u long, vs array<long>, vecs binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, label)
    name = os.path.basename(path).replace("-", "_")
    with shuffles_end_with_queries(spark):
        made.repartition(buckets, "u").write.bucketBy(buckets, "u").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name), name


def _numbers(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where the lists begin and end among them."""
    held = batch.column(column)
    offsets = held.offsets.to_numpy()
    return held.values.to_numpy(zero_copy_only=False), offsets


def _split_hubs(table: DataFrame, frontier: DataFrame, hub: int) -> DataFrame:
    """The frontier's rows with their nodes' lists; the rows of a node that more than hub queries expand are dealt out in parts."""
    parts = frontier.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("parts")).where("parts > 1")
    parts = materialise(parts, "hubs")  # a row for so many rows of the frontier
    others = table.join(frontier.join(parts, "u", "left_anti").hint("shuffle_hash"), "u")
    lists = table.join(parts, "u").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = frontier.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("of"), F.col("parts").cast("long")).cast("int"))
    columns = ["of", "q", "bar", "vs", "vecs"]
    return others.select(*columns).unionByName(asked.drop("parts").join(lists.drop("parts"), ["u", "part"]).select(*columns))


def search_graph(graph: DataFrame, packed: DataFrame, width: int, queries: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """node (of the query), ids: its pool after the last hop, best first. queries has the columns node and x."""
    spark = packed.sparkSession
    table, name = _bucketed(two_way_lists(graph, packed, s), packed, "neighbour-vectors")
    starts = packed.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(s.entries).collect()
    starts += packed.orderBy(F.desc("short"), "node").limit(s.entries).collect()
    entries = {r.node: bytes(r.vec) for r in starts}
    # what the entries list is scored at the start, so that no hop sends all queries to the same few nodes
    known = dict(entries)
    for row in table.where(F.col("u").isin(list(entries))).select("vs", "vecs").collect() if entries else []:  # entries x a list's length
        vecs = bytes(row.vecs)
        known.update((v, vecs[k * width : (k + 1) * width]) for k, v in enumerate(row.vs))
    start_ids = np.array(list(known), np.int64)
    start_vectors = unpack_vectors(b"".join(known.values()), width)[:, :-1]
    expanded = np.isin(start_ids, list(entries)).astype(np.int8)

    def pooled(ids: np.ndarray, sims: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((-done, ids, -sims))
        ids, sims, done = ids[order], sims[order], done[order]
        _, once = np.unique(ids, return_index=True)
        once = np.sort(once)[: s.pool]
        return ids[once], sims[once], done[once]

    def stored(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        lists = _lists(*(list(c) for c in zip(*rows, strict=True))) if rows else _lists([], [], [])
        return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("q"), *lists], ["node", "q", "ids", "sims", "done"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, q in zip(batch.column("node").to_pylist(), batch.column("q").to_pylist(), strict=True):
                ids = np.concatenate([[node], start_ids])
                sims = np.concatenate([[np.inf], start_vectors @ np.frombuffer(q, "<f4")])
                done = np.concatenate([[expanded[start_ids == node].max(initial=0)], expanded]).astype(np.int8)
                rows.append(pooled(ids, sims, done))
            yield stored(batch, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each list met, what is nearer to the query than the end of its pool."""
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                (vs, offsets), sizes = _numbers(batch, "vs"), np.diff(batch.column("vs").offsets.to_numpy())
                vs = vs[offsets[0] : offsets[-1]]
                x = unpack_vectors(b"".join(batch.column("vecs").to_pylist()), width)[:, :-1]
                q = np.frombuffer(b"".join(batch.column("q").to_pylist()), "<f4").reshape(batch.num_rows, -1)
                sims = np.einsum("ij,ij->i", x, np.repeat(q, sizes, axis=0))
                better = sims > np.repeat(batch.column("bar").to_numpy(), sizes)
                left = np.add.reduceat(np.append(better, 0), np.append(0, np.cumsum(sizes))[:-1]) * (sizes > 0)
                ends = pa.array(np.append(0, np.cumsum(left)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v[better].astype(t))) for v, t in ((vs, np.int64), (sims, np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column("of"), *lists], ["of", "vs", "ps"])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = {c: _numbers(batch, c) for c in ("ids", "sims", "done", "vs", "ps")}
            for k in range(batch.num_rows):
                ids, sims, done, vs, ps = (v[o[k] : o[k + 1]] for v, o in columns.values())
                done = done.copy()
                done[np.flatnonzero(done == 0)[: s.open]] = 1  # those that were expanded for this hop
                fresh = ~np.isin(vs, ids)
                vs, ps = vs[fresh], ps[fresh]
                rows.append(pooled(np.concatenate([ids, vs]), np.concatenate([sims, ps]), np.concatenate([done, np.zeros(len(vs), np.int8)])))
            yield stored(batch, rows)

    schema = "node long, q binary, ids array<long>, sims array<float>, done array<tinyint>"
    # a query's length leaves its order as it is; its largest component is made one
    largest = F.array_max(F.transform("x", lambda v: F.abs(v)))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [np.array(v, "<f4").tobytes() for v in batch.column("q").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(q, pa.binary())], ["node", "q"])

    held = queries.select("node", F.transform("x", lambda v: v / largest).alias("q")).mapInArrow(as_bytes, "node long, q binary")
    state = materialise(held.mapInArrow(begin, schema), "search-0")
    none = {"vs": F.expr("cast(array() as array<bigint>)"), "ps": F.expr("cast(array() as array<float>)")}
    for hop in range(1, MOST_TURNS):
        open_ = F.slice(F.filter(F.arrays_zip("ids", "done"), lambda e: e["done"] == 0), 1, s.open)
        bar = F.when(F.size("ids") >= s.pool, F.element_at("sims", -1)).otherwise(F.lit(-math.inf)).cast("float")
        frontier = materialise(state.select(F.col("node").alias("of"), "q", bar.alias("bar"), F.explode(open_).alias("e")).select("of", "q", "bar", F.col("e.ids").alias("u")), "frontier")
        asked = frontier.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("size"), F.max("n").alias("most")).first()
        size = asked.size or 0
        if not size:
            for done in (frontier, table):
                discard(done)
            spark.sql(f"DROP TABLE {name}")
            return state.select("node", "ids")
        side = F.broadcast(frontier) if size * (4 * width + 32) <= BROADCAST_BYTES else frontier.hint("shuffle_hash")
        met = table.join(side, "u").select("of", "q", "bar", "vs", "vecs")
        if size * (4 * width + 32) > BROADCAST_BYTES and asked.most > s.hub:
            met = _split_hubs(table, frontier, s.hub)
        met = met.mapInArrow(score, "of long, vs array<long>, ps array<float>")
        met = met.where(F.size("vs") > 0).groupBy("of").agg(F.flatten(F.collect_list("vs")).alias("vs"), F.flatten(F.collect_list("ps")).alias("ps"))
        joined = state.join(met, state.node == met["of"], "left").drop("of").withColumns({c: F.coalesce(c, e) for c, e in none.items()})
        after = materialise(joined.mapInArrow(advance, schema), f"search-{hop}")
        discard(state)
        discard(frontier)
        state = after
    raise RuntimeError("the search doesn't end")


def nearest(
    embeddings: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    graph_settings: GraphSettings = GraphSettings(), search_settings: SearchSettings = SearchSettings(),
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of queries, itself left out.

    queries are rows of embeddings.
    """
    rows = usable(embeddings, id_column, vector_column)
    nodes, members = nodes_and_members(rows, k + 1)
    packed, width = packed_nodes(nodes)
    graph = nn_descent(packed, width, graph_settings)
    asked = queries.select(F.col(id_column).cast("long").alias("query_id"), F.transform(F.col(vector_column), lambda v: v.cast("double")).alias("x"))
    asked = materialise(asked.where("query_id is not null").join(nodes, "x").select("query_id", "node"), "queries")
    pools = search_graph(graph, packed, width, nodes.join(asked.select("node").distinct(), "node"), search_settings)

    product = F.aggregate(F.zip_with("qx", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    near = pools.select("node", F.explode(F.slice("ids", 1, 4 * k)).alias("found"))
    near = near.unionByName(pools.select("node", F.col("node").alias("found"))).distinct()
    scored = near.join(nodes.select("node", F.col("x").alias("qx")), "node").join(nodes.select(F.col("node").alias("found"), "x"), "found")
    scored = scored.select("node", "found", product.alias("score"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    listed = scored.join(members.select(F.col("node").alias("found"), "vec_id"), "found").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = asked.join(listed.select("node", "vec_id", "score"), "node").where("query_id <> vec_id")
    return each.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
