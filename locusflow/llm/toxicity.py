"""Operator 9: toxicity from a lexicon trie, Levenshtein automata and context windows.

learn() finds the lexicon on a bounded sample of labelled rows: words, and stems of four to six
letters, that stand in many toxic texts and hardly any clean ones, more often than chance and
after many different words; distinct texts count, so that copies don't vote twice. Each word of a text is looked up in the lexicon's trie: exactly, by
stem, or by running the word's Levenshtein automaton (one edit, words of five letters or more)
down the trie. A digit or one of * @ $ _ between letters hides a letter: such a word goes through the
automaton as a whole. Misspellings that clean training texts use as words of their own are exempt. A
window around each hit weighs it: less between quotation marks or near words of reporting, more
near words that address the reader. A logistic curve fitted on the sample turns the summed
evidence into a score from 0 to 1.

Null and empty texts have no evidence and get the score of that. Whole texts are read, whatever
their length. Labels for unknown documents and null labels are ignored; repeated label rows count
once. Without a toxic training row the lexicon is empty and every score is 0. A null doc_id is
not held out. Empty tables give empty results. Columns of other names are carried or ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package

#: Different labelled texts that learn() may use, taken by hash. They bound the lexicon and the exempt spellings, too,
#: all of whose words stand in them; neither has a limit of its own.
TRAIN_ROWS = 20_000
#: An entry stands in this share of distinct toxic texts at least, and its odds are this much higher there.
MIN_SHARE, MIN_LOG_ODDS = 0.01, 3.0
#: Log-likelihood gain over chance, beyond the log of the number of terms tested.
MIN_GAIN = 3.0
#: Different words before an entry, as a share of the texts that hold it: copies have the same.
MIN_VARIETY = 0.25
STEMS = (4, 5, 6)
FUZZY_LETTERS = 5
FUZZY_FACTOR = 0.6
WINDOW = 60
THRESHOLD = 0.3
HELD_OUT_REMAINDER = 2
#: Verdicts on words that a worker keeps.
CACHE_ENTRIES = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_MASK = re.compile(r"(?<=[^\W\d_])[0-9*@$_](?=[^\W\d_])")
_QUOTES = "\"“”„«»‘’‹›"
_REPORTING = frozenset("said says wrote quoted quote called calls according term word sagte schrieb dit écrit dijo escribió".split())
_ADDRESS = frozenset("you your yours u ur du dich dein tu toi vous votre eres usted tú".split())
QUOTED_FACTOR, REPORTED_FACTOR, ADDRESS_FACTOR = 0.4, 0.6, 1.2


class Trie:
    """Lexicon words by letter; an entry's weight is under the empty string."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.root: dict = {}
        for word, weight in weights.items():
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = weight

    def within_one_edit(self, word: str) -> tuple[str, float] | None:
        """The heaviest entry at distance one or less: the word's automaton run down the trie.

        The automaton's states are bits: bit i says that i letters of the word are used up. There
        is a word of bits for no error and one for one error.
        """
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        accept = 1 << len(word)
        best = None
        stack = [(self.root, "", 1, 0b11)]
        while stack:
            node, path, exact, one = stack.pop()
            for letter, below in node.items():
                if letter == "":
                    if (exact | one) & accept and (best is None or below > best[1]):
                        best = (path, below)
                    continue
                here = places.get(letter, 0)
                exact2 = (exact & here) << 1
                one2 = (one & here) << 1 | exact | exact << 1 | exact2 << 1
                if exact2 or one2:
                    stack.append((below, path + letter, exact2, one2))
        return best


@dataclass
class ToxicModel:
    """What learn() found: bounded in size, so that it can be sent to every task."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exempt: frozenset = frozenset()
    curve: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        self._trie = Trie({w: v for w, v in self.words.items() if len(w) >= FUZZY_LETTERS})
        self._longest = max((len(w) for w in self.words), default=0)
        self._seen: dict[str, tuple[float, bool]] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "exempt": self.exempt, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def weigh(self, word: str) -> tuple[float, bool]:
        """The word's weight, and whether only a misspelling gave it one."""
        found = self._seen.get(word)
        if found is None:
            found = self._weigh(word)
            if len(self._seen) >= CACHE_ENTRIES:
                self._seen.clear()
            self._seen[word] = found
        return found

    def _weigh(self, word: str) -> tuple[float, bool]:
        if word in self.words:
            return self.words[word], False
        stem = max((self.stems[word[:n]] for n in STEMS if word[:n] in self.stems and len(word) >= n), default=0.0)
        if stem:
            return stem, False
        near = self.weigh_misspelt(word)
        return near, near > 0

    def weigh_misspelt(self, word: str) -> float:
        """The word's weight as a misspelling; one longer than every entry plus a letter is none."""
        if not FUZZY_LETTERS <= len(word) <= self._longest + 1 or word in self.exempt:
            return 0.0
        near = self._trie.within_one_edit(word)
        return FUZZY_FACTOR * near[1] if near else 0.0

    def masked(self, low: str) -> Iterator[tuple[int, int]]:
        """Start and end of the words with a hidden letter that are short enough for an entry."""
        most = self._longest + 1
        for found in _MASK.finditer(low):
            start, end = found.span()
            while start and end - start <= most and _is_letter(low[start - 1]):
                start -= 1
            while end < len(low) and end - start <= most and _is_letter(low[end]):
                end += 1
            if end - start <= most:
                yield start, end

    def evidence(self, text: str | None) -> float:
        """Summed weights of the hits in a text, each under its context."""
        if not text or not (self.words or self.stems):
            return 0.0
        low = text.lower()
        weigh = self.weigh
        hits = {w: v[0] for w in set(_WORD.findall(low)) if (v := weigh(w))[0]}
        hidden = [(start, end, weight) for start, end in self.masked(low) if (weight := self.weigh_misspelt(low[start:end]))]
        if not hits and not hidden:
            return 0.0
        total = sum(weight * context_factor(low, start, end) for start, end, weight in hidden)
        inside = {at for start, end, _ in hidden for at in range(start, end)}  # runs of letters in them don't count again
        for found in _WORD.finditer(low):
            weight = hits.get(found.group())
            if weight and found.start() not in inside:
                total += weight * context_factor(low, found.start(), found.end())
        return total

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        base, slope = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, base + slope * math.log1p(self.evidence(text))))))


def _is_letter(sign: str) -> bool:
    return sign.isalnum() and not sign.isdecimal()


def context_factor(low: str, start: int, end: int) -> float:
    """How much a hit counts: quotation and reporting lower it, address raises it."""
    before, after = low[max(0, start - WINDOW) : start], low[end : end + WINDOW]
    factor = 1.0
    if any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES):
        factor *= QUOTED_FACTOR
    near = set(_WORD.findall(before)) | set(_WORD.findall(after))
    if near & _REPORTING:
        factor *= REPORTED_FACTOR
    if near & _ADDRESS and factor == 1.0:
        factor *= ADDRESS_FACTOR
    return factor


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def is_held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT_REMAINDER, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and y of the documents of at most `rows` labelled ids, none of them held out."""
    named = labels.select(F.col("doc_id").cast("long").alias("of_id"), F.col("toxic").cast("int").alias("y"))
    named = named.where(F.col("of_id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("of_id")))
    chosen = named.groupBy("of_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("of_id"), "of_id").limit(rows)
    held = _texts(docs)
    return held.join(F.broadcast(chosen), held.doc_id == chosen.of_id).select("text", "y")  # the ids are `rows` at most


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicModel:
    spark = docs.sparkSession
    ship_package(spark)
    sample = training_sample(docs, labels, rows).where("length(text) > 0")
    once = materialise(sample.groupBy("text").agg(F.max("y").alias("y")), "toxicity-sample")
    if once.count() > rows:  # an id may have many texts
        digest = F.xxhash64("text")
        least = once.select(digest.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("h")).first().h
        once = once.where(digest <= F.lit(least))
    sizes = {r.y: r.n for r in once.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return ToxicModel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                terms = words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}
                by_class[y].update(terms)
        for y in (0, 1):
            terms = list(by_class[y])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([y] * len(terms), pa.int32()), pa.array([by_class[y][t] for t in terms], pa.int64())], ["term", "y", "n"])

    counted = once.mapInArrow(count, "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    counted = counted.where(F.col("t") >= 3)
    tested = counted.count()
    t, c, share = F.col("t"), F.col("c"), toxic / max(1, toxic + clean)
    odds = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    gain = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
    often = counted.where(t >= math.ceil(MIN_SHARE * toxic)).withColumn("w", odds)
    often = often.where((F.col("w") >= MIN_LOG_ODDS) & (gain >= math.log(max(1, tested)) + MIN_GAIN))
    found = often.orderBy(F.desc("t"), "term").collect()  # words of the sample
    proposed = frozenset(r.term for r in found)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                before = ""
                for word in _WORD.findall(text.lower()):
                    for term in (word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)):
                        if term in proposed:
                            seen.add((term, before))
                    before = word
        pairs = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["term", "before"])

    varied = once.where("y = 1").mapInArrow(neighbours, "term string, before string").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    contexts = {r.term: r.n for r in varied.collect()}  # a row for each proposed entry
    entries = [r for r in found if contexts.get(r.term, 0) >= max(3, MIN_VARIETY * r.t)]
    model = ToxicModel({r.term: r.w for r in entries if r.term[-1] != "*"}, {r.term[:-1]: r.w for r in entries if r.term[-1] == "*"})

    def near_misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                low = text.lower()
                found.update(w for w in set(_WORD.findall(low)) if model.weigh(w)[1])
                found.update(w for w in {low[start:end] for start, end in model.masked(low)} if model.weigh_misspelt(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    clean_rows = once.where("y = 0")
    misses = clean_rows.mapInArrow(near_misses, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    model.exempt = frozenset(r.word for r in misses.select("word").collect())  # words of the sample
    model.__post_init__()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [model.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.log1p(seen))], ["y", "x"])

    points = once.mapInArrow(measure, "y int, x double").collect()  # at most `rows` pairs of numbers
    model.curve = fit_curve(np.array([p.x for p in points]), np.array([p.y for p in points], dtype=float))
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> tuple[float, float]:
    """Base and slope of a logistic curve, by Newton steps with a small ridge."""
    design, at = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (y - p) - ridge * at
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(2)
        at = at + np.linalg.solve(curve, slope)
    return float(at[0]), float(max(0.0, at[1]))


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shared.value.score(t) for t in batch.column("text").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t) < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_documents(docs, learn(docs, labels), threshold)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
