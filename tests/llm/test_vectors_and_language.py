"""Hard negatives, vector codes and language identification against brute force, and their edge cases."""

import hashlib
import os
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import language_id, negatives, vector_codes
from locusflow.llm import queries as corpus_queries
from locusflow.llm.negatives import KeySettings

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, page long, uid long, x string, window int, score long, squared long"
EXTRA = [7, 7, "x", 1, 2, 3]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, *EXTRA) for i, v, y in rows], SCHEMA)


def whole(v):
    return v is not None and len(v) > 0 and all(e is not None and np.isfinite(e) for e in v)


def floored(v, factor):
    return [int(np.floor(float(np.float32(e)) * factor)) for e in v]


def random_rows(n, width, seed, labels=4):
    """Clusters, a vector that a third of the rows share, repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width))
    rows = [(int(i), (centers[i % 6] * 0.4 + rng.normal(size=width) * 0.2).tolist(), int(rng.integers(0, labels))) for i in range(n)]
    rows = [(i, centers[0].tolist() if i % 3 == 0 else v, y) for i, v, y in rows]
    rows += [rows[0], rows[1], rows[1], (100, rows[5][1], 1)]
    odd = [None, [], [None] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [1.0] * (width + 1)]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)]
    return rows + [(2000, [0.5] * width, None), (None, [0.5] * width, 1), (2100, [0.0] * width, 1), (2001, [0.0] * width, 2)]


# hard negatives


def mined(rows, width, k=5):
    held = [(i, y, floored(v, 256)) for i, v, y in rows if i is not None and y is not None and whole(v) and len(v) == width]
    found = []
    for a, (anchor, label, x) in enumerate(held):
        if anchor % 100:
            continue
        scored = [(-int(np.dot(x, z)), i, u, y) for u, (i, y, z) in enumerate(held) if u != a]
        for s, i, _, _ in sorted(r for r in scored if r[3] == label)[:k]:
            allowed = sorted(r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s)[:k]
            found += [(anchor, i, rank, j, -s, -t) for rank, (t, j, _, _) in enumerate(allowed, 1)]
    return Counter(found)


@pytest.mark.parametrize("settings", [KeySettings(), KeySettings(pivots=3, page=7, chunk=2, radii=(0.01, 0.05, 0.2)), KeySettings(pivots=1, page=50, chunk=1, radii=())])
def test_hard_negatives(spark, settings):
    rows = random_rows(420, 6, 3)
    found = negatives.mine_hard_negatives(vectors(spark, rows).repartition(5), F.col("vec_id") % 100 == 0, settings=settings)
    assert found.dtypes[0] == ("anchor_id", "bigint") and dict(found.dtypes)["rank"] == "int"
    wanted = mined(rows, 6)
    assert len(wanted) > 50
    assert Counter(tuple(r) for r in found.collect()) == wanted


def test_hard_negatives_of_little(spark):
    condition = F.col("vec_id") % 100 == 0
    assert negatives.mine_hard_negatives(vectors(spark, []), condition).collect() == []
    assert negatives.mine_hard_negatives(vectors(spark, [(100, None, 1), (200, [1.0], None)]), condition).collect() == []
    alone = [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 2)]
    assert negatives.mine_hard_negatives(vectors(spark, alone), condition).collect() == []
    against = [(100, [1.0, 0.0], 1), (101, [-1.0, 0.0], 1), (102, [-0.9, 0.0], 2)]  # a positive of negative score
    assert negatives.mine_hard_negatives(vectors(spark, against), condition).collect() == []
    zeros = [(i, [0.0, 0.0], i % 2) for i in range(100, 112)]
    found = negatives.mine_hard_negatives(vectors(spark, zeros), condition).collect()
    assert Counter(map(tuple, found)) == mined(zeros, 2) and len(found) == 25
    nothing_asked = negatives.mine_hard_negatives(vectors(spark, against), F.lit(None).cast("boolean"))
    assert nothing_asked.collect() == []
    with pytest.raises(ValueError, match="too large"):
        negatives.mine_hard_negatives(vectors(spark, [(100, [1e30, 0.0], 1)]), condition)


def test_hard_negatives_with_wide_numbers(spark):
    rows = [(i, [float((i * 37) % 11 - 5) * 3000, float(i % 7) * 2000], i % 3) for i in range(260)]
    found = negatives.mine_hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    assert Counter(tuple(r) for r in found.collect()) == mined(rows, 2)


# vector codes


def coded(rows, width, parts=4, entries=256, rounds=4):
    """Lloyd's rounds with whole numbers, one part after another."""
    held = [(i, y, floored(v, 1024)) for i, v, y in rows if whole(v) and len(v) == width]
    held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = width // parts
    split = [[x[p * w : (p + 1) * w] for p in range(parts)] for _, _, x in held]
    books = [[split[r][p] for r in range(min(entries, len(held)))] for p in range(parts)]

    def nearest(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in split:
                groups.setdefault(nearest(p, row[p])[0], []).append(row[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], Counter()
    for (i, y, _), row in zip(held, split, strict=True):
        each = [nearest(p, v) for p, v in enumerate(row)]
        out.append((i, "".join(f"{e:02x}" for e, _ in each), sum(d for _, d in each), y))
        sums[y] += out[-1][2]
    return Counter((i, code, error, sums[y], digest) for i, code, error, y in out)


@pytest.mark.parametrize(("n", "entries", "rounds"), [(300, 16, 4), (300, 256, 2), (20, 256, 4), (300, 5, 0)])
def test_vector_codes(spark, n, entries, rounds):
    rows = random_rows(n, 8, 5)
    found = vector_codes.compress(vectors(spark, rows).repartition(6), entries=entries, rounds=rounds)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == coded(rows, 8, entries=entries, rounds=rounds)


def test_vector_codes_of_little(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, [1.0, 2.0], 1), (2, None, 1)])).collect() == []  # four parts need four components
    one = vector_codes.compress(vectors(spark, [(None, [-0.5, 0.25, 1.0, 7.0], None)])).collect()
    assert [tuple(r)[:4] for r in one] == [(None, "00000000", 0, 0)]
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(vectors(spark, [(1, [1e30] * 4, 1)]))


def test_only_changes_are_sent(spark):
    """What the tasks of a round send adds up to the moves between two assignments, nothing else."""
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (500, 8))
    shape = vector_codes.Shape(8, 50)
    first = vector_codes.Codebooks(np.stack([x[:9, :4], x[:9, 4:]]), shape)
    sums = vector_codes.RunningSums(first)
    a = first.nearest(x)[0]
    vector_codes.changes(x, None, a, sums)
    second = vector_codes.Codebooks(sums.entries(first.entries), shape)
    b = second.nearest(x)[0]
    moved = vector_codes.RunningSums(first)
    vector_codes.changes(x, a, b, moved)
    assert 0 < np.abs(moved.n).sum() <= 2 * (a != b).sum() < 2 * a.size
    for part in range(2):
        for e in range(9):
            own = x[b[:, part] == e, part * 4 : part * 4 + 4]
            assert sums.n[part, e] + moved.n[part, e] == len(own)
            assert (sums.sums[part, e] + moved.sums[part, e] == own.sum(axis=0)).all()


# language


def grams_of(text, most=4):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = Counter()
    for w in words:
        framed = f" {w} "
        for n in range(1, most + 1):
            found.update(framed[k : k + n] for k in range(len(framed) - n + 1) if framed[k : k + n].strip())
    return found


TEXTS = ["One two, three", "", None, "12 34 !", "Ünïcode ßtraße, übér", "a", "x" * 30, "no\nlines\t\there ", "Ωμέγα 日本語 и так", "same same Same"]


def test_grams(spark):
    """Each n-gram has one bucket: counts by text agree with those of the n-grams themselves."""
    found = [Counter() for _ in TEXTS]
    for of, buckets in language_id.grams(TEXTS):
        for i, b in zip(of.tolist(), buckets.tolist(), strict=True):
            found[i][b] += 1
    for text, held in zip(TEXTS, found, strict=True):
        wanted = grams_of(text or "")
        assert sum(held.values()) == sum(wanted.values())
        assert len(held) >= 0.99 * len(wanted) and sorted(held.values())[-3:] == sorted(wanted.values())[-3:]
    alone = [Counter(b for _, bs in language_id.grams([t]) for b in bs.tolist()) for t in TEXTS]
    assert alone == found  # a text's neighbours don't matter


def test_long_texts_are_read_whole():
    rng = np.random.default_rng(0)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(120_000))
    n = sum(len(b) for _, b in language_id.grams([None, text, "tail"]))
    assert n == 120_000 * (5 + 6 + 5 + 4) + (4 + 5 + 4 + 3)
    assert all(len(t) <= 3 * language_id.PIECE for _, parts in language_id._pieces([text, "x" * 700_000]) for t in parts)
    assert "".join(t for _, parts in language_id._pieces([text, "x" * 700_000]) for t in parts) == text + "x" * 700_000


@pytest.mark.parametrize(("languages", "bits", "apart"), [(2, 1, 1), (3, 3, 2), (4, 7, 4), (6, 31, 16), (20, 40, 12), (60, 40, 8)])
def test_codewords(languages, bits, apart):
    words = language_id.codewords(languages)
    assert words.shape[1] == bits if languages <= language_id.EXHAUSTIVE else words.shape[1] >= bits
    assert set(np.unique(words)) == {-1, 1}
    assert (np.abs(words.sum(axis=0)) < languages).all()
    divisions = {tuple(c * c[0]) for c in words.T.astype(int)}
    assert len(divisions) == words.shape[1]
    assert min((words[a] != words[b]).sum() for a, b in combinations(range(languages), 2)) >= apart


def test_decoding_corrects_a_wrong_bit():
    words = language_id.codewords(4)
    model = language_id.LanguageModel(("a", "b", "c", "d"), words, np.zeros((7, 2)), np.ones(7), np.zeros(7), np.ones(7))
    for own in range(4):
        for wrong in range(7):
            evidence = 3 * words[own].copy()
            evidence[wrong] = -evidence[wrong]
            assert model.losses(evidence[None])[0].argmin() == own
    nothing_known = language_id.LanguageModel(model.names, words, np.zeros((7, language_id.BUCKETS)), np.ones(7), np.zeros(7), np.ones(7))
    names, score, ambiguous = nothing_known.predict(["abc", ""])
    assert names == ["a", "und"] and abs(score[0] - 0.25) < 1e-9 and ambiguous.all()
    doubted = language_id.LanguageModel(model.names, words, model.weights, np.ones(7), np.zeros(7), np.array([0.1, 0.1, 0.1, 1, 1, 1, 1]))
    evidence = 3 * words[2].copy()
    evidence[:3] = -evidence[:3]  # three wrong bits that aren't trusted
    assert doubted.losses(evidence[None])[0].argmin() == 2


DOCS = "doc_id long, text string, lang string, source string, bucket int, n long, evidence string, held_out string, score string"
WORDS = {"xx": ["alo", "belu", "cari", "dona"], "yy": ["shtrk", "wrgh", "kvint", "zlod"], "zz": ["ooee", "aiu", "eeio", "uuoa"]}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, y, "s", 1, 2, "e", "h", "c") for i, t, y in rows], DOCS)


def invented(n, seed=2):
    rng = np.random.default_rng(seed)
    names = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[names[i % 3]], rng.integers(1, 30))), names[i % 3]) for i in range(n)]


def test_languages(spark):
    rows = invented(240)
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "12 -- 7", "zz"), (503, "alo belu", None), (None, "wrgh zlod", None), rows[3], rows[3], (504, "alo " * 30_000, None)]
    found = {}
    for r in language_id.detect_languages(documents(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(len(v) for v in found.values()) == len(rows)
    for i, text, lang in rows[:240]:
        assert all(r.lang_pred == lang and 0.5 < r.score <= 1 and not r.ambiguous for r in found[i]), text
    for i in (500, 501, 502):
        assert [(r.lang_pred, r.score, r.ambiguous) for r in found[i]] == [("und", 0.0, True)]
    assert found[503][0].lang_pred == found[504][0].lang_pred == "xx" and found[None][0].lang_pred == "yy" and not found[None][0].held_out
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, rs in found.items() if i is not None for r in rs)


def test_held_out_labels_are_not_read(spark):
    import zlib

    rows = invented(120)
    base = {r.doc_id: tuple(r) for r in language_id.detect_languages(documents(spark, rows)).collect()}
    moved = [(i, t, "other" if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, t, y in rows]
    assert {r.doc_id: tuple(r) for r in language_id.detect_languages(documents(spark, moved)).collect()} == base


def test_languages_with_little_to_learn_from(spark):
    assert language_id.detect_languages(documents(spark, [])).collect() == []
    nobody = language_id.detect_languages(documents(spark, [(0, "alo", None), (1, "belu", None)])).collect()
    assert [(r.lang_pred, r.score, r.ambiguous) for r in nobody] == [("und", 0.0, True)] * 2
    one = language_id.detect_languages(documents(spark, [(0, "alo", "xx"), (1, "belu", None), (2, "5", "yy")])).collect()
    assert [(r.lang_pred, r.score) for r in one] == [("xx", 1.0), ("xx", 1.0), ("und", 0.0)]


def test_counts_are_of_all_texts(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("alo alo", "xx"), ("alo", "xx"), ("Alo!", "yy"), (None, "yy")])]
    found = Counter()
    for r in language_id.gram_counts(documents(spark, rows).repartition(3)).collect():
        found[r.lang] += r.n
    assert found == {"xx": 3 * sum(grams_of("alo").values()), "yy": sum(grams_of("alo").values())}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared test tables")
def test_held_out_accuracy(spark):
    found = corpus_queries.op13_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
