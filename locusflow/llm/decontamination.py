"""Operator 3: benchmark decontamination by a positional inverted index, in DataFrame functions.

The corpus is counted for the benchmark's words only; that tells the rarest two words of each
window of the benchmark. Postings (term, document, position) of these words are stored as a table.
Lists of the two words, each moved back by its offset in the item, are intersected: what is left
says that an item may stand in a document from some position on. Each such place is then compared
word by word with the item, window by window, in one more pass over the texts, which counts the
words that lie in an occurrence of a window.

The report also counts proximity matches, from the same lists: items of which a window's two
rarest words stand in the document in their order of the item, at a distance that differs by up
to `slop` words from that in the item, where none of its windows stands there exactly.

A window is `width` consecutive words of an item; an item with fewer words, but not none, is one
window. Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Null
texts have no words. A document is known by doc_id and text, so rows that share a doc_id don't
mix, and repeated rows get equal results. An item without an id marks words but is not named.
Empty tables are allowed on either side; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LOWER, UPPER, materialise, small

WIDTH = 13
#: Words by which a proximity match may be longer or shorter than in the item.
SLOP = 3
#: A document is contaminated if one in this many of its words is hit.
WORDS_A_HIT = 20

_BREAKS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def words_of(text: Column) -> Column:
    """The words of a text, in order, as an array."""
    spaced = F.trim(F.translate(text, UPPER + _BREAKS, LOWER + " " * len(_BREAKS)))
    return F.when(F.coalesce(F.length(spaced), F.lit(0)) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(spaced, " +"))


def _documents(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id (as text), item_words and span, the words in one of its windows."""
    words = words_of(F.col("text").cast("string"))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("item_words")).where(F.size("item_words") > 0)
    return rows.distinct().select(F.xxhash64("item_id", "item_words").alias("item_key"), "item_id", "item_words")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """item_key, first (of the window), at (in the item) and term, a row for each word of a window.

    A term is the 64-bit hash of a word, which joins faster than text; places that a collision adds
    don't pass the comparison word by word.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("item_words") - width, F.lit(0)))
    firsts = items.select("item_key", "item_words", F.explode(starts).alias("first"))
    held = firsts.select("item_key", "first", F.posexplode(F.slice("item_words", F.col("first") + 1, F.lit(width))).alias("k", "term"))
    return held.select("item_key", "first", (F.col("first") + F.col("k")).alias("at"), F.xxhash64("term").alias("term"))


def corpus_counts(docs: DataFrame, terms: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """term and n, its occurrences in all documents, for the given terms."""
    # outer: else the optimizer splits each text once more to ask whether it has any words
    words = _documents(docs).select(F.explode_outer("words").alias("word")).where("word is not null").select(F.xxhash64("word").alias("term"))
    return words.join(small(terms, most), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The index: term, doc_id, text_hash and position of each occurrence of the given terms."""
    words = _documents(docs).select("doc_id", "text_hash", F.posexplode_outer("words").alias("position", "word"))
    words = words.where("word is not null").select("doc_id", "text_hash", "position", F.xxhash64("word").alias("term"))
    found = words.join(small(terms, most), "term").select("term", "doc_id", "text_hash", "position")
    return materialise(found, "postings")


def rarest_terms(windows: DataFrame, counts: DataFrame, lists: int = 2) -> DataFrame:
    """The rarest words of each window that can occur at all: item_key, first, at, term, needed."""
    known = windows.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_window = Window.partitionBy("item_key", "first")
    ranked = known.withColumn("least", F.min("n").over(of_window)).where("least > 0")
    ranked = ranked.withColumn("r", F.row_number().over(of_window.orderBy("n", "at"))).where(F.col("r") <= lists)
    return ranked.withColumn("needed", F.count(F.lit(1)).over(of_window)).select("item_key", "first", "at", "term", "needed")


def possible_places(index: DataFrame, rarest: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Intersected lists: item_key, doc_id, text_hash and origin, where the item's first word would be."""
    moved = index.join(small(rarest, most), "term").select(
        "doc_id", "text_hash", "item_key", "first", "needed", "at", (F.col("position") - F.col("at")).alias("origin")
    )
    met = moved.groupBy("doc_id", "text_hash", "item_key", "first", "needed", "origin").agg(F.count_distinct("at").alias("lists"))
    return met.where(F.col("lists") == F.col("needed")).select("doc_id", "text_hash", "item_key", "origin").distinct()


def index_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BROADCAST_BYTES):
    """Stored items, rarest terms of their windows, and postings of those terms."""
    items = materialise(benchmark_items(benchmark), "items")
    windows = materialise(_windows(items, width), "windows")
    terms = materialise(windows.select("term").distinct(), "terms")
    counts = materialise(corpus_counts(docs, terms, most), "counts")
    rarest = materialise(rarest_terms(windows, counts), "rarest")
    index = postings(docs, materialise(rarest.select("term").distinct(), "anchors"), most)
    return items, rarest, index


def proximity_matches(rarest: DataFrame, index: DataFrame, slop: int = SLOP, most: int = BROADCAST_BYTES) -> DataFrame:
    """Windows whose two rarest words stand within `slop` words of their distance in the item.

    item_key, first, doc_id, text_hash, origin and shift (0: the exact distance). Places are dealt
    out by document and by stretches of slop + 1 words, each looked up with its neighbours.
    """
    lead = Window.partitionBy("item_key", "first").orderBy("at")
    sides = rarest.where("needed = 2").withColumn("lead", F.row_number().over(lead) == 1)
    moved = index.join(small(materialise(sides, "sides"), most), "term").withColumn("origin", F.col("position") - F.col("at"))
    stretch = F.floor(F.col("origin") / (slop + 1))
    keys = ["doc_id", "text_hash", "item_key", "first"]
    a = moved.where("lead").select(*keys, "origin", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    b = moved.where("not lead").select(*[F.col(c).alias(f"other_{c}") for c in keys], F.col("origin").alias("other"), stretch.alias("other_stretch"))
    same = F.col("stretch") == F.col("other_stretch")
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"other_{c}")) if c == "doc_id" else F.col(c) == F.col(f"other_{c}")
    met = a.join(b, same).withColumn("shift", F.col("other") - F.col("origin"))
    return met.where(F.abs("shift") <= slop).select("item_key", "first", "doc_id", "text_hash", "origin", "shift")


def exact_matches(docs: DataFrame, items: DataFrame, rarest: DataFrame, index: DataFrame, width: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (sorted ids) and keys (of items) of each row of docs."""
    places = possible_places(index, rarest, most).groupBy("doc_id", "text_hash", "item_key").agg(F.collect_list("origin").alias("origins"))
    places = materialise(places, "places").join(small(items, most), "item_key")
    by_item = F.struct("item_key", "item_id", "item_words", "origins")
    by_document = places.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(by_item).alias("places"))
    by_document = small(materialise(by_document, "places-by-document"), most)
    held = _documents(docs)  # words are split below the join: above it, each use would split the text again
    joined = held.join(by_document, held.doc_id.eqNullSafe(F.col("d")) & (held.text_hash == F.col("h")), "left")

    def occurrences(p: Column) -> Column:
        """Positions in the document of the words of the item's windows that stand there."""
        span = F.least(F.size(p["item_words"]), F.lit(width))
        firsts = F.sequence(F.lit(0), F.size(p["item_words"]) - span)

        def at_origin(origin: Column) -> Column:
            def stands(first: Column) -> Column:
                at = origin + first
                inside = (at >= 0) & (at + span <= F.size("words"))
                return F.when(inside, F.slice("words", at + 1, span) == F.slice(p["item_words"], first + 1, span)).otherwise(F.lit(False))

            return F.flatten(F.transform(F.filter(firsts, stands), lambda first: F.sequence(origin + first, origin + first + span - 1)))

        hit = F.array_distinct(F.flatten(F.transform(p["origins"], at_origin)))
        return F.struct(p["item_key"].alias("item_key"), p["item_id"].alias("item_id"), hit.alias("hit"))

    found = F.filter(F.transform("places", occurrences), lambda o: F.size(o["hit"]) > 0)
    seen = joined.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.when(F.col("places").isNotNull(), found).alias("found"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("found", lambda o: o["hit"]))))
    named = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda o: o["item_id"]), lambda i: i.isNotNull())))
    return seen.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.when(F.col("found").isNull(), 0).otherwise(hit).cast("long").alias("n_hit"),
        F.coalesce(named, F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce(F.transform("found", lambda o: o["item_key"]), F.expr("cast(array() as array<bigint>)")).alias("keys"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (sorted ids), keys of each row of docs."""
    items, rarest, index = index_benchmark(docs, benchmark, width, most)
    return exact_matches(docs, items, rarest, index, width, most)


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (WORDS_A_HIT * F.col("n_hit") >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near, items near but not exact."""
    items, rarest, index = index_benchmark(docs, benchmark, width, most)
    exact = exact_matches(docs, items, rarest, index, width, most)
    near = proximity_matches(rarest, index, slop, most).where("shift <> 0").select("doc_id", "text_hash", "item_key").distinct()
    near = near.groupBy(F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_hash")).agg(F.collect_list("item_key").alias("near"))
    near = small(materialise(near, "near-items"), most)
    joined = exact.join(near, F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("text_hash") == F.col("near_hash")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        F.coalesce(F.size(F.array_except("near", "keys")), F.lit(0)).cast("long").alias("n_near"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    gone = contamination(docs, benchmark, **options).where(is_contaminated()).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_hash"])
    return docs.join(gone, same, "left_anti")
