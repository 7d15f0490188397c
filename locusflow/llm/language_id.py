"""Operator 13: language identification by error-correcting output codes.

Each language has a codeword; each bit of the codewords divides the languages in two, and a binary
classifier over character n-grams predicts it. Decoding sums over the bits the logistic loss of
what was predicted against each language's codeword, weighted by how far the bit's classifier
can be trusted, and takes the language of least loss. Where the next language's loss is close, the text
is marked ambiguous.

A classifier's weights are log ratios of the n-grams' shares on its two sides, from counts over all
documents learnt from: tasks count, Spark sums by language and bucket, and what reaches the driver
is languages x BUCKETS counts at most. Slope, offset and trust of each bit are fitted on a bounded
sample of the same documents, CALIBRATION_ROWS by hash of id and text; nothing else is sampled.

N-grams are of one to four characters within words, of lower-cased letters, with the words' ends as
a character; words are runs of letters, by Unicode. Texts of any length are read whole, in
pieces that end between words.

Null texts, empty ones and those without a letter get `und`, score 0 and ambiguous true; so does every
text if there is nothing to learn from. With one language to learn from, every text with a letter
is that, score 1. Languages are the values of lang that occur with a letter in what is learnt
from; rows without a lang aren't learnt from. A row without an id isn't held out. Repeated rows
count as often as they occur. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package

#: Buckets that n-grams are hashed to, as a power of two.
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SIZES = 4
#: Labelled rows that slopes, offsets and trust are fitted on, at most.
CALIBRATION_ROWS = 8_000
#: Characters of texts taken together.
PIECE = 200_000
#: Up to so many languages every division of them is a bit; beyond, BITS drawn ones.
EXHAUSTIVE, BITS = 6, 63
#: Added to each count.
SMOOTHING = 0.5
#: Least difference of losses between the first language and the second of a text that isn't ambiguous.
CLEAR = 1.0
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers of texts and parts of them, in order, PIECE characters or a little more at a time."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = at + PIECE - size
            if end < len(text):
                space = text.rfind(" ", at + 1, end)
                end = space if space > 0 else at + PIECE  # a word longer than a piece is cut
            numbers.append(i)
            parts.append(text[at:end])
            size += len(parts[-1])
            at = end
            if size >= PIECE // 2:
                yield np.array(numbers), parts
                numbers, parts, size = [], [], 0
    if parts:
        yield np.array(numbers), parts


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts and buckets of their n-grams, a size and a piece at a time."""
    for numbers, parts in _pieces(texts):
        lowered = [p.lower() for p in parts]
        codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(numbers, [len(p) + 1 for p in lowered])  # the end after a text is its own
        owner = np.append(numbers[0], owner)
        codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
        kept = np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))
        codes, owner = codes[kept], owner[kept]
        letter = codes != 0
        rolled, inside = codes.copy(), None
        for n in range(1, SIZES + 1):
            if n == 1:
                valid, of = letter, owner
            else:
                rolled = rolled[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
                inside = np.ones(len(rolled), bool) if n == 2 else inside[:-1] & letter[n - 2 : -1]
                valid, of = inside, owner[1 : 1 + len(rolled)]
            held = rolled[valid] + np.uint64(n * 0xD1342543DE82EF95 % 2**64)
            held = (held ^ (held >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            yield of[valid], (held >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def codewords(languages: int, seed: int = 3) -> np.ndarray:
    """languages x bits of -1 and 1. No bit is the same for all languages, no two bits divide them alike."""
    if languages <= 1:
        return np.ones((languages, 0))
    if languages <= EXHAUSTIVE:
        held = [1 + np.array(c, int) for k in range(1, languages) for c in combinations(range(languages - 1), k)]
        bits = -np.ones((languages, len(held)))
        for column, members in enumerate(held):
            bits[members, column] = 1
        return bits
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(200):
        drawn = rng.integers(0, 2, (languages, BITS)) * 2 - 1
        drawn = drawn * drawn[:1]  # the first language has 1 everywhere: divisions and their opposites are one
        drawn = np.unique(drawn[:, (drawn < 0).any(axis=0)], axis=1)
        apart = min(int((drawn[a] != drawn[b]).sum()) for a, b in combinations(range(languages), 2))
        if apart > least:
            best, least = drawn.astype(float), apart
    return best


@dataclass(frozen=True)
class LanguageModel:
    """names of the languages; words: their codewords; weights: bits x BUCKETS; slope, offset, trust: of each bit."""

    names: tuple[str, ...]
    words: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """texts x bits: the weights' sum over a text's n-grams by the root of their number; and that number."""
        total, n = np.zeros((len(texts), len(self.weights))), np.zeros(len(texts), np.int64)
        for of, buckets in grams(texts):
            n += np.bincount(of, minlength=len(texts))
            for k, own in enumerate(self.weights):
                total[:, k] += np.bincount(of, own[buckets], minlength=len(texts))
        return total / np.sqrt(np.maximum(n, 1))[:, None], n

    def losses(self, evidence: np.ndarray) -> np.ndarray:
        """texts x languages: the trusted bits' logistic losses against each codeword."""
        margin = evidence * self.slope + self.offset
        return np.stack([(self.trust * np.logaddexp(0, -margin * word)).sum(axis=1) for word in self.words], axis=1) if self.names else np.zeros((len(evidence), 0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of each text."""
        evidence, n = self.evidence(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        losses = self.losses(evidence)
        best = losses.argmin(axis=1)
        least = losses.min(axis=1)
        score = 1 / np.exp(least[:, None] - losses).sum(axis=1)
        second = np.partition(losses, 1, axis=1)[:, 1] if len(self.names) > 1 else np.full(len(texts), np.inf)
        known = n > 0
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), ~known | (second - least < CLEAR)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of labelled (text, lang); a task sends a row for each bucket it has seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").dictionary_encode()
            names, own = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for of, buckets in grams(texts):
                held = np.bincount(own[of] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    seen[name] = seen[name] + held[k] if name in seen else held[k]
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    made = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    return made.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def bit_weights(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """bits x buckets: log ratios of the shares on the two sides, each language weighing the same."""
    shares = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1])
    return np.array([np.log(shares[bit > 0].mean(axis=0) / shares[bit < 0].mean(axis=0)) for bit in words.T]).reshape(words.shape[1], counts.shape[1])


def fit_bit(evidence: np.ndarray, sides: np.ndarray, turns: int = 25) -> tuple[float, float, float]:
    """Slope and offset of the logistic curve from evidence to side, and the trust: how much better than the larger side it does."""
    if len(set(sides.tolist())) < 2:
        return 1.0, 0.0, 1.0
    x = np.stack([evidence, np.ones(len(evidence))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = p * (1 - p) + 1e-6
        gradient = x.T @ ((sides > 0) - p) - 1e-3 * (beta - [1, 0])
        step = np.linalg.solve((x * w[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        beta = beta + np.clip(step, -2, 2)
    right = ((x @ beta > 0) == (sides > 0)).mean()
    guess = max((sides > 0).mean(), (sides < 0).mean())
    return float(beta[0]), float(beta[1]), float(np.clip((right - guess) / (1 - guess), 0.05, 1.0))


def fit(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel:
    """A model of the languages in labelled: doc_id, text, lang."""
    table = gram_counts(labelled).toArrow()  # languages x BUCKETS rows at most
    langs = table.column("lang").to_pylist()
    names = tuple(sorted(set(langs)))
    counts = np.zeros((len(names), BUCKETS))
    at = {name: i for i, name in enumerate(names)}
    counts[[at[x] for x in langs], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    words = codewords(len(names))
    bits = words.shape[1]
    raw = LanguageModel(names, words, bit_weights(counts, words).astype(np.float32), np.ones(bits), np.zeros(bits), np.ones(bits))
    if not bits:
        return raw
    digest = F.xxhash64("doc_id", "text")
    least = labelled.select(digest.alias("h")).orderBy("h").limit(calibration_rows).agg(F.max("h").alias("h")).first().h  # numbers travel, no texts

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, n = raw.evidence(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n), pa.array(evidence.tolist(), pa.list_(pa.float64()))], ["lang", "n", "evidence"])

    measured = labelled.where(digest <= F.lit(least)).select("text", "lang").mapInArrow(measure, "lang string, n long, evidence array<double>")
    rows = measured.where("n > 0").limit(calibration_rows).collect()  # repeated rows share a digest
    evidence = np.array([r.evidence for r in rows]).reshape(len(rows), bits)
    own = words[[at[r.lang] for r in rows]]
    slope, offset, trust = (np.array(c) for c in zip(*(fit_bit(evidence[:, k], own[:, k]) for k in range(bits)), strict=True))
    return LanguageModel(names, words, raw.weights, slope, offset, trust)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row of documents (doc_id, text)."""
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # bits x BUCKETS weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, ambiguous = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous)], [c.split()[0] for c in RESULT.split(", ")])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(work, RESULT)


def detect_languages(documents: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """Learn from the rows that aren't held out and have a lang, and predict all rows."""
    ship_package(documents.sparkSession)
    labelled = documents.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return identify(documents, fit(labelled.select("doc_id", "text", "lang"), calibration_rows))
