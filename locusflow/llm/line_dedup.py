"""Operator 1: line dedup by a segment-partition edit join.

Lines are the pieces of a text between line feeds. A line goes if it repeats an earlier line, or
if an earlier different line is within its edit budget of insertions, deletions and substitutions;
earlier is by doc_id, then text hash, then place. The budget grows with the length, in classes; of
two lines the shorter one's holds. Equal lines are one entry, known by a 128-bit digest. Near
lines: an entry is cut into budget + 1 segments, one of which an entry within the budget must hold
unchanged, near its place. Segments are the keys of an index by length; each entry probes the
indexes of its own and of slightly shorter lengths. Entries that share a key are compared by a
banded bit-parallel edit distance on the texts themselves.

A key that many entries share would give the square of their number of candidate pairs. At a
budget of one edit such entries are met through their one-deletion variants instead, which only
lines one edit apart share, and each is compared with the first of its group alone: all others of
a group are then that near as well, so the same lines go. At larger budgets a key's lines meet in
one block of bounded size, where a task compares counts of characters first, which no edit changes
by more than two, then distances until a line has met an earlier one that is near. If a key has
more lines than a block, what they have beside the shared segment is cut again: within a key, lines
that are near are near in the rest too, so the rest is cut into budget + 1 segments of its own,
which make keys below the key, and so on until a block holds them. What all rests of a key have in
common at their start and end is taken off first, so lines of one template are cut by what varies
in them. Where at most `budget` characters are left, all entries of one length are near one another
and meet the first alone; longer or shifted ones are dealt out to pairs of blocks.

Blank lines always stay, and so do null texts. Lines shorter than the first class only go if
repeated exactly. Rows that share doc_id and text are treated alike, as one document. A null
doc_id comes before all others. Texts may be of any length. An empty table gives no rows; columns
of other names are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, materialise, ship_package, small

#: Classes of lines: the least length and the edits allowed from there on, three at most.
BUDGETS = ((20, 1), (60, 2))
#: Entries under a key that are still compared pair by pair; lines in a block of a key of more that can't be cut again.
HOT, BLOCK = 32, 2_048
#: Kinds of characters that are counted, and lines whose counts are compared with a block at once.
KINDS, STEP = 32, 64

#: Odd base of the rolling hash over code points, and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 nearly equal segments, the longer ones last."""
    size, longer = divmod(length, edits + 1)
    sizes = [size + (i > edits - longer) for i in range(edits + 1)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def budget_of(length: int, budgets: Sequence[tuple[int, int]] = BUDGETS) -> int:
    """The edits allowed for a line of this length; 0 below the first class."""
    return max((edits for least, edits in budgets if length >= least), default=0)


@lru_cache(maxsize=1_024)
def _key_plan(n: int, budgets: tuple[tuple[int, int], ...]) -> tuple[int, list[tuple[int, int, int, int]]]:
    """How many index keys a line of length n has, and (start, end, seed, edits) of each key, those first; in bytes."""
    own = budget_of(n, budgets)
    index = [(4 * a, 4 * (a + s), n << 4 | i, own) for i, (a, s) in enumerate(segments(n, own))] if own else []
    probe = set()
    for length in range(max(1, n - max((e for _, e in budgets), default=0)), n + 1):
        edits, more = budget_of(length, budgets), n - length
        if more > edits or not edits:
            continue
        for i, (a, s) in enumerate(segments(length, edits)):
            low = max(0, a - i, a + more - (edits - i))
            high = min(n - s, a + i, a + more + (edits - i))
            probe.update((4 * k, 4 * (k + s), length << 4 | i, edits) for k in range(low, high + 1))
    return len(index), index + sorted(probe - set(index))


def segment_keys(line: str, budgets: Sequence[tuple[int, int]] = BUDGETS) -> tuple[list[int], list[int]]:
    """Index keys of a line, and the keys it probes for lines as long or shorter; a key's last two bits are its budget."""
    from xxhash import xxh64_intdigest

    raw = line.encode("utf-32-le", "surrogatepass")
    n_index, plan = _key_plan(len(line), tuple(budgets))
    keys = [(xxh64_intdigest(raw[start:end], seed) & ~3 | edits) - 2**63 for start, end, seed, edits in plan]
    return keys[:n_index], keys[n_index:]


def within_edits(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of a and b is at most edits.

    Equal ends are cut off. Bit d of the word for e errors says that with e errors and j characters
    of b used up, j - edits + d characters of a may be used up: only the band is kept.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    least = min(len(a), len(b))
    start = _common(a, b, least)
    end = _common(a[::-1], b[::-1], least - start)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    width = 2 * edits + 1
    band = (1 << width) - 1
    words = [1 << edits]
    for _ in range(edits):
        words.append((words[-1] | words[-1] << 1) & band)
    for j, letter in enumerate(b):
        match = 0
        for d in range(width):
            i = j - edits + d
            if 0 <= i < len(a) and a[i] == letter:
                match |= 1 << d
        before, words[0] = words[0], words[0] & match
        for e in range(1, edits + 1):
            before, words[e] = words[e], (words[e] & match) | before | before >> 1 | (words[e - 1] << 1) & band
        if not any(words):
            return False
    return bool(words[edits] >> (len(a) - len(b) + edits) & 1)


def _common(a: str, b: str, most: int) -> int:
    """How many characters a and b share at their start, at most `most`."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def variant_keys(line: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Hash of a line, of its one-deletion variants, and of these together with the place."""
    with np.errstate(over="ignore"):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers)])
        cut = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
        placed = (cut ^ (np.arange(len(codes), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(_BASE)
        # the length keeps a variant of one line apart from another's of equal sum
        whole = int((sums[-1] + np.uint64(len(codes))) * np.uint64(_BASE))
        cut = (cut + np.uint64(max(len(codes) - 1, 0))) * np.uint64(_BASE)
    return whole, np.unique(cut), placed


def _keyed(docs: DataFrame) -> DataFrame:
    """row, all columns of docs as one, beside text and the columns _id and _hash that name a document here."""
    text = F.col("text").cast("string")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"))


def _line_entries(docs: DataFrame) -> DataFrame:
    """A row for each different line that isn't blank: digest, first place and the line itself."""
    schema = "doc_id long, doc_hash long, place int, a long, b long, line string"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, doc_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for place, line in enumerate((text or "").split("\n")):
                    if not line or line.isspace():
                        continue
                    digest = xxhash.xxh128_intdigest(line.encode("utf-8", "surrogatepass"))
                    values = (doc_id, doc_hash, place, (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, line)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    held = _keyed(docs).select(F.col("_id").alias("doc_id"), F.col("_hash").alias("doc_hash"), "text")
    first = F.min(F.struct("doc_id", "doc_hash", "place")).alias("first")
    return held.mapInArrow(cut, schema).groupBy("a", "b").agg(first, F.first("line").alias("line"))


def _keys(entries: DataFrame, budgets: Sequence[tuple[int, int]]) -> DataFrame:
    """key, id and indexed (1, or 0 for a probe) of each entry."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, indexed = [], [], []
            for id_, line in zip(batch.column("a").to_pylist(), batch.column("line").to_pylist(), strict=True):
                index, probe = segment_keys(line, budgets)
                keys += index + probe
                ids += [id_] * (len(index) + len(probe))
                indexed += [1] * len(index) + [0] * len(probe)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(indexed, pa.int32())], ["key", "id", "indexed"])

    return entries.select("a", "line").mapInArrow(make, "key long, id long, indexed int")


def _shared_keys(entries: DataFrame, budgets: Sequence[tuple[int, int]], hot: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (u, v) of digests under keys of few entries, and members (key, n, id, indexed, edits) of hot keys."""
    keys = _keys(entries, budgets)
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("indexed").alias("n_index"), F.min("id").alias("u"), F.max("id").alias("v"))
    shared = materialise(counted.where("n > 1 and n_index > 0 and u <> v"), "shared-keys")
    twos = shared.where("n = 2").select("u", "v")
    more = materialise(shared.where("n > 2").select("key", "n"), "crowded-keys")
    members = materialise(keys.join(small(more, most), "key"), "shared-members")
    pairs = twos.unionByName(_pairs_in(members.where(F.col("n") <= hot))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    crowded = members.where(F.col("n") > hot).withColumn("edits", F.pmod("key", F.lit(4)).cast("int"))
    return materialise(pairs, "line-pairs"), materialise(crowded, "hot-members")


def _hot_pairs(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs of hot entries one edit apart: each with the first of its group, or with its variant."""

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, line in zip(batch.column("id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                whole, cut, placed = variant_keys(line)
                keys = np.concatenate([np.array([whole], np.uint64), cut, placed]).view(np.int64)
                role = np.repeat(np.array([0, 1, 2], np.int32), [1, len(cut), len(placed)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(role), pa.array(np.full(len(keys), id_, np.int64))], ["key", "role", "id"])

    lines = texts.join(hot, texts.id == hot.u, "left_semi").select("id", "line")
    keys = lines.mapInArrow(vary, "key long, role int, id long")
    firsts = texts.select(F.col("id").alias("of"), "first")
    heads = keys.groupBy(F.col("key"), (F.col("role") == 2).alias("placed")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("role") == 0, F.col("id"))).alias("whole")
    )
    heads = materialise(heads.where("n > 1 and (placed or whole is not null)"), "variant-heads")
    members = keys.where("role > 0").join(heads, (keys.key == heads.key) & ((F.col("role") == 2) == F.col("placed"))).select(keys.key, "placed", "whole", "id")
    members = materialise(members.join(firsts, members.id == firsts.of).drop("of"), "variant-members")
    least = members.where("placed").groupBy("key").agg(F.min(F.struct("first", "id")).alias("head")).select(F.col("key").alias("k"), F.col("head.id").alias("head"))
    same = members.where("placed").join(least, F.col("key") == F.col("k")).select(F.col("id").alias("u"), F.col("head").alias("v"))
    longer = members.where("not placed").select(F.col("id").alias("u"), F.col("whole").alias("v"))
    return same.unionByName(longer).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def character_counts(lines: Sequence[str]) -> np.ndarray:
    """How often characters of each kind, by the last bits of their code, stand in each line."""
    out = np.zeros((len(lines), KINDS), np.int32)
    for k, line in enumerate(lines):
        out[k] = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") % KINDS, minlength=KINDS)
    return out


def _block_links(members: DataFrame, texts: DataFrame, budgets: Sequence[tuple[int, int]], block: int) -> DataFrame:
    """a_first, b_first: for each line of a key that has an earlier near one under it, one such pair a block pair."""
    first = "struct<doc_id:bigint,doc_hash:bigint,place:int>"
    lines = members.join(texts.select(F.col("id").alias("of"), "first", "line"), F.col("id") == F.col("of"))
    lines = lines.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    dealt = lines.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "indexed", "first", "line")

    def meet(group: pa.Table) -> pa.Table:
        firsts, held = group.column("first").combine_chunks(), group.column("line").to_pylist()
        own, indexed = group.column("own").to_numpy(), group.column("indexed").to_numpy().astype(bool)
        apart = group.column("x")[0].as_py() != group.column("y")[0].as_py()
        places = [(f["doc_id"] is not None, f["doc_id"] or 0, f["doc_hash"], f["place"]) for f in firsts.to_pylist()]
        order = np.array(sorted(range(len(held)), key=places.__getitem__))
        held, own, indexed = [held[k] for k in order], own[order], indexed[order]
        counts, sizes = character_counts(held), np.array([len(x) for x in held])
        edits = np.array([budget_of(n, budgets) for n in sizes])
        found: list[tuple[int, int]] = []
        for at in range(0, len(held), STEP):
            late = np.arange(at, min(at + STEP, len(held)))
            early = np.arange(late[-1] + 1)
            allowed = np.minimum(edits[late][:, None], edits[early][None, :])
            near = np.abs(counts[late][:, None, :] - counts[early][None, :, :]).sum(axis=2) <= 2 * allowed
            near &= (early[None, :] < late[:, None]) & (indexed[late][:, None] | indexed[early][None, :])
            if apart:
                near &= own[late][:, None] != own[early][None, :]
            for k, row in zip(late.tolist(), near, strict=True):
                for j in np.flatnonzero(row).tolist():
                    if held[j] != held[k] and within_edits(held[j], held[k], int(min(edits[j], edits[k]))):
                        found.append((j, k))
                        break
        a, b = (pa.array([int(order[pair[side]]) for pair in found], pa.int64()) for side in (0, 1))
        return pa.table({"a_first": firsts.take(a), "b_first": firsts.take(b)})

    return dealt.groupBy("key", "x", "y").applyInArrow(meet, f"a_first {first}, b_first {first}")


def rests_of(line: str, keys: set[int], budgets: Sequence[tuple[int, int]] = BUDGETS) -> list[tuple[int, int, int, str]]:
    """(key, indexed, length, rest) under those of a line's keys that are given.

    rest: the line without the key's segment; length: that of the rest of the key's indexed lines.
    """
    from xxhash import xxh64_intdigest

    raw = line.encode("utf-32-le", "surrogatepass")
    n_index, plan = _key_plan(len(line), tuple(budgets))
    out = set()
    for k, (start, end, seed, edits) in enumerate(plan):
        key = (xxh64_intdigest(raw[start:end], seed) & ~3 | edits) - 2**63
        if key in keys:
            out.add((key, int(k < n_index), (seed >> 4) - (end - start) // 4, line[: start // 4] + line[end // 4 :]))
    return sorted(out)


def cut_rest(key: int, indexed: int, length: int, rest: str) -> list[tuple[int, int, int, str]]:
    """The same one level down: keys of the segments of a rest, below its key."""
    from xxhash import xxh64_intdigest

    edits, more = (key + 2**63) & 3, len(rest) - length
    raw = rest.encode("utf-32-le", "surrogatepass")
    out = set()
    for i, (at, size) in enumerate(segments(length, edits)):
        low = max(0, at - i, at + more - (edits - i))
        high = min(len(rest) - size, at + i, at + more + (edits - i))
        for k in range(low, high + 1):
            below = xxh64_intdigest(raw[4 * k : 4 * (k + size)], (key + i * _BASE) % 2**64) & ~3 | edits
            out.add((below - 2**63, int(indexed and k == at), length - size, rest[:k] + rest[k + size :]))
    return sorted(out)


_RESTS = "key long, id long, indexed int, length int, rest string"
_REST_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
_REST_NAMES = [c.split()[0] for c in _RESTS.split(", ")]


def _rest_batch(rows: list[tuple[int, int, int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _REST_NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _REST_KINDS, strict=True)], _REST_NAMES)


def _first_rests(texts: DataFrame, crowded: DataFrame, budgets: Sequence[tuple[int, int]]) -> DataFrame:
    keys = crowded.groupBy(F.col("id").alias("of")).agg(F.collect_set("key").alias("keys"))  # a line has few keys

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = zip(*(batch.column(c).to_pylist() for c in ("id", "line", "keys")), strict=True)
            yield _rest_batch([(key, id_, *found) for id_, line, held in lines for key, *found in rests_of(line, set(held), budgets)])

    return texts.join(keys, F.col("id") == F.col("of")).select("id", "line", "keys").mapInArrow(make, _RESTS)


def _crowds(rests: DataFrame) -> DataFrame:
    """key, n, length, head and tail (the characters that all rests share at their ends) of keys under which lines can meet."""
    turned = F.reverse("rest")
    counted = rests.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("length"), F.max("indexed").alias("any_indexed"), (F.min("id") < F.max("id")).alias("several"),
        F.min("rest").alias("a"), F.max("rest").alias("b"), F.min(turned).alias("c"), F.max(turned).alias("d"), F.min(F.length("rest")).alias("least"),
    )
    schema = "key long, n long, length int, head int, tail int"

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c, d, least = (batch.column(x).to_pylist() for x in ("a", "b", "c", "d", "least"))
            head = [_common(x, y, n) for x, y, n in zip(a, b, least, strict=True)]
            tail = [_common(x, y, n - h) for x, y, n, h in zip(c, d, least, head, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("key", "n", "length")), pa.array(head, pa.int32()), pa.array(tail, pa.int32())], ["key", "n", "length", "head", "tail"])

    return counted.where("several and any_indexed = 1").mapInArrow(shared, schema)


def _pairs_in(members: DataFrame) -> DataFrame:
    """u, v of the entries under keys of few members, one of them indexed."""
    groups = members.groupBy("key").agg(F.collect_set(F.struct("id", "indexed")).alias("m"))
    one = groups.select("m", F.explode("m").alias("x")).where("x.indexed = 1")
    return one.select(F.col("x.id").alias("u"), F.explode("m.id").alias("v")).where("u <> v")


def _cut_crowds(texts: DataFrame, crowded: DataFrame, budgets: Sequence[tuple[int, int]], hot: int, block: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Candidate pairs (u, v) under keys of more than a block, level by level, and members (key, n, id, indexed) that must meet in blocks.

    Each level takes a share of one in budget + 1 off what is left of the lines, so levels follow
    the logarithm of their length; rows of a level are a fixed number times those above it.
    """
    rests = materialise(_first_rests(texts, crowded, budgets), "cut-rests", compression="zstd")
    pairs, ends = [], []
    while True:
        crowds = materialise(_crowds(rests), "cut-crowds")
        if crowds.isEmpty():
            break
        members = rests.drop("length").join(small(crowds, most), "key")
        pairs.append(materialise(_pairs_in(members.where(F.col("n") <= hot)), "cut-pairs"))
        left = F.col("length") - F.col("head") - F.col("tail")
        edits = F.pmod("key", F.lit(4)).cast("int")
        held = members.where(F.col("n") > hot)
        ends.append(materialise(held.where((F.col("n") <= block) | (left <= edits)).groupBy("key", "id").agg(F.max("n").alias("n"), F.max("indexed").alias("indexed")), "cut-ends"))
        go = held.where((F.col("n") > block) & (left > edits)).select("key", "id", "indexed", left.alias("length"), F.expr("substring(rest, head + 1, length(rest) - head - tail)").alias("rest"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2_000):
                    rows = zip(*(c.to_pylist() for c in batch.slice(at, 2_000).columns), strict=True)
                    yield _rest_batch([(below, id_, *found) for key, id_, *held in rows for below, *found in cut_rest(key, *held)])

        after = materialise(go.mapInArrow(cut, _RESTS), "cut-rests", compression="zstd")
        discard(rests)
        rests = after
    every = reduce(DataFrame.unionByName, ends) if ends else rests.select("key", "id", F.lit(0).cast("long").alias("n"), "indexed")
    ended = every.where(F.col("n") > block)
    firsts = texts.select(F.col("id").alias("of"), "first")
    same = ended.where("indexed = 1").join(firsts, F.col("id") == F.col("of"))
    heads = same.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("first", "id")).alias("head"))
    pairs.append(materialise(same.join(heads, F.col("key") == F.col("k")).select(F.col("id").alias("u"), F.col("head.id").alias("v")).where("u <> v"), "cut-pairs"))
    mixed = ended.groupBy(F.col("key").alias("k")).agg(F.min("indexed").alias("lo"), F.max("indexed").alias("hi")).where("lo < hi")
    blocks = every.where(F.col("n") <= block).unionByName(ended.join(mixed, F.col("key") == F.col("k"), "left_semi"))
    return pairs, materialise(blocks, "cut-blocks")


def near_links(entries: DataFrame, budgets: Sequence[tuple[int, int]] = BUDGETS, hot: int = HOT, block: int = BLOCK, most: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs within the budget: a_first, b_first, the places of the first lines of both kinds.

    Every pair under a key of few entries is compared; under hot keys each line that goes is in
    some pair.
    """
    pairs, crowded = _shared_keys(entries, budgets, hot, most)
    wanted = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).unionByName(crowded.select(F.col("id").alias("u"))).distinct()
    wanted = small(materialise(wanted, "wanted"), most)
    texts = entries.join(wanted, entries.a == wanted.u, "left_semi").select(F.col("a").alias("id"), "first", "line")
    texts = materialise(texts, "line-texts")
    varied = crowded.where("edits = 1").select(F.col("id").alias("u")).distinct()
    if not varied.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(texts, varied)).distinct()
    wide = crowded.where("edits > 1")
    blocked, cut = wide.where(F.col("n") <= block).select("key", "n", "id", "indexed"), wide.where(F.col("n") > block)
    if not cut.isEmpty():
        more, below = _cut_crowds(texts, cut, budgets, hot, block, most)
        blocked = blocked.unionByName(below)
        below = reduce(DataFrame.unionByName, more).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs = materialise(pairs.unionByName(below).distinct(), "line-pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = zip(batch.column("a_line").to_pylist(), batch.column("b_line").to_pylist(), strict=True)
            near = [within_edits(a, b, budget_of(min(len(a), len(b)), budgets)) for a, b in lines]
            yield batch.filter(pa.array(near, pa.bool_())).select(["a_first", "b_first"])

    sides = [texts.select(F.col("id").alias(c), F.col("first").alias(f"{n}_first"), F.col("line").alias(f"{n}_line")) for c, n in (("u", "a"), ("v", "b"))]
    held = pairs.join(sides[0], "u").join(sides[1], "v").select("a_first", "a_line", "b_first", "b_line")
    first = "struct<doc_id:bigint,doc_hash:bigint,place:int>"
    links = held.mapInArrow(compare, f"a_first {first}, b_first {first}")
    return links if blocked.isEmpty() else links.unionByName(_block_links(blocked, texts, budgets, block))


def kept_lines(docs: DataFrame, budgets: Sequence[tuple[int, int]] = BUDGETS, hot: int = HOT, block: int = BLOCK, most: int = BROADCAST_BYTES) -> DataFrame:
    """kept_id, kept_hash and the sorted places of the lines that stay, for documents that have any.

    Without budgets only exact repeats go.
    """
    if any(not 1 <= edits <= 3 for _, edits in budgets) or list(budgets) != sorted(budgets) or any(least <= edits for least, edits in budgets):
        raise ValueError("budgets must rise with the length, be from 1 to 3 and shorter than their lines")
    ship_package(docs.sparkSession)
    entries = materialise(_line_entries(docs), "line-entries", compression="zstd")
    stay = entries.select("first")
    if budgets:
        links = near_links(entries, budgets, hot, block, most)
        gone = materialise(links.select(F.greatest("a_first", "b_first").alias("first")).distinct(), "near-lines")
        stay = stay.join(small(gone, most), "first", "left_anti")
    places = F.array_sort(F.collect_list("first.place")).alias("kept_places")
    return stay.groupBy(F.col("first.doc_id").alias("kept_id"), F.col("first.doc_hash").alias("kept_hash")).agg(places)


def _rebuild(text: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the lines that go, its lines before and after, blank ones not counted."""
    if text is None:
        return None, 0, 0
    stay = set(places or ())
    lines = text.split("\n")
    blank = [not line or line.isspace() for line in lines]
    left = [line for k, line in enumerate(lines) if blank[k] or k in stay]
    return "\n".join(left), blank.count(False), len(stay)


def dedup_lines(docs: DataFrame, drop_emptied: bool = True, **options) -> DataFrame:
    """docs with the repeated lines taken out of text and n_chars, if there, put right.

    A document that had lines and is left with none is a repeat as a whole; drop_emptied leaves it
    out.
    """
    ship_package(docs.sparkSession)
    kept = kept_lines(docs, **options)
    keyed = _keyed(docs)
    joined = keyed.join(kept, keyed._id.eqNullSafe(kept.kept_id) & (keyed._hash == kept.kept_hash), "left").select("row", "text", "kept_places")
    names = docs.columns
    at, lengths = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_rebuild(t, p) for t, p in zip(batch.column("text").to_pylist(), batch.column("kept_places").to_pylist(), strict=True)]
            columns = batch.column("row").flatten()
            columns[at] = pa.array([m[0] for m in made], columns[at].type)
            if lengths >= 0:
                columns[lengths] = pa.array([None if m[0] is None else len(m[0]) for m in made], columns[lengths].type)
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out.filter(pa.array([not (drop_emptied and m[1] and not m[2]) for m in made], pa.bool_()))

    return joined.mapInArrow(apply, docs.schema)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines and n_kept (blank lines not counted), text_sha256 of the text that is left."""
    ship_package(docs.sparkSession)
    kept = kept_lines(docs, **options)
    keyed = _keyed(docs)
    joined = keyed.join(kept, keyed._id.eqNullSafe(kept.kept_id) & (keyed._hash == kept.kept_hash), "left")
    joined = joined.select(F.col("_id").alias("doc_id"), "text", "kept_places")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_rebuild(t, p) for t, p in zip(batch.column("text").to_pylist(), batch.column("kept_places").to_pylist(), strict=True)]
            digests = [hashlib.sha256((m[0] or "").encode("utf-8", "surrogatepass")).hexdigest() for m in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array(digests)],
                ["doc_id", "n_lines", "n_kept", "text_sha256"],
            )

    return joined.mapInArrow(tell, "doc_id long, n_lines long, n_kept long, text_sha256 string")
