"""Operator 2: personal data by patterns, checksums and context words, in DataFrame functions.

Patterns propose spans, leftmost and without overlap within a kind; validators confirm them
(number ranges, digit counts, Luhn, mod 97). A confirmed span has a score: high where the kind
proves itself, low where it doesn't (account numbers of no known country, keys without a known
prefix), and higher where a context word stands near. Spans of the added kinds need the least
score, so for those of low score the context decides; spans of the contract's four kinds stay
whatever their score, which the report gives.

A kind costs one pass over a text: its matches are set between marks, the text is cut at the
marks, and lengths of the pieces add up to code-point offsets, by blocks, so that a text of very
many spans takes time in proportion. A mark that a text holds is changed to another character
before, which no pattern knows either.

The patterns are written with possessive runs and start only where a run starts (or where the
last match ended), so that a long run of letters or digits is read once.

Null text counts as empty; a null doc_id and repeated rows are kept as they are. An empty table
gives no rows, and further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Countries by the length of their account numbers; other codes may have any length.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
KNOWN_COUNTRIES = "|".join(" ".join(ACCOUNT_LENGTHS.values()).split())


def _account_pattern() -> str:
    """Account numbers, grouped by four or not: of their country's length, or of any for other codes.

    A word in capitals that follows belongs to the span only where no length is known.
    """
    known = []
    for length, countries in ACCOUNT_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        known.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    other = rf"(?!{KNOWN_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|{other})(?![A-Za-z0-9])"


#: Fixed values of the contract, in its order, each as a pattern that finds the same spans.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _account_pattern(),
    "secret": r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{20,}+",
}
#: How keys begin that tell by this whose they are.
KEY_PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk_test_|xoxb-|xoxp-|eyJ"
BASE_KINDS = ("email", "ip", "card", "phone")
#: A text without this has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT_WORDS = {
    "email": "mail|contact|write|reach",
    "ip": r"\bip\b|server|host|login|address",
    "card": "card|visa|credit|payment|debit",
    "phone": r"phone|\btel\b|call|mobile|fax|whatsapp",
    "iban": "iban|bank|account|transfer",
    "secret": "token|secret|passw|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|auth",
}
#: Code points on either side of a span that are searched for context words.
CONTEXT_WIDTH = 40
#: Scores in hundredths: a span whose kind proves itself, one whose kind doesn't, what a context word
#: adds, and the least score of an added kind.
VALID_SCORE, UNSURE_SCORE, CONTEXT_SCORE, LEAST_SCORE = 60, 30, 40, 50
#: Stands on both sides of a match in the marked text, and what a text's own are changed to.
MARK, OTHER = "\ue000", "\ue001"
#: Spans whose offsets are added up at once.
BLOCK = 256


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        value = F.substring(turned, i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 0, value * 2 - F.when(value > 4, 9).otherwise(0)).otherwise(value)
        return total + doubled

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97_ok(span: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters put last."""
    plain = F.regexp_replace(span, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    total = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)
    return F.length(plain).between(15, 34) & (total == 1)


def _confirmed(kind: str, span: Column) -> Column:
    if kind == "ip":
        # parts of more than three digits, once zeros in front are gone, are over 255
        parts = F.transform(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        digits = _digits(span)
        return F.when(F.length(digits).between(13, 19), luhn_ok(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    if kind == "iban":
        return mod97_ok(span)
    if kind == "secret":
        return F.regexp_like(span, F.lit("[0-9]")) & F.regexp_like(span, F.lit("[A-Za-z]"))
    return F.lit(True)


def _parts(kind: str, text: Column) -> Column:
    """The text cut at the ends of its matches: between, match, between, ..., between."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), PATTERNS[kind], f"{MARK}$0{MARK}")
    cut = F.split(marked, MARK, -1)
    return F.when(F.instr(text, NEEDS[kind]) > 0, cut).otherwise(F.array(F.lit(""))) if kind in NEEDS else cut


def _count(parts: Column) -> Column:
    return (F.size(parts) / 2).cast("int")


def _before(sizes: Column) -> Column:
    """For each of an array of numbers the sum of those before it: of blocks first, then inside them."""

    def running(values: Column, start: Column) -> Column:
        def add(done: Column, v: Column) -> Column:
            return F.struct((done["at"] + v).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))

        begin = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(values, begin, add, lambda done: done["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.size(sizes), F.lit(BLOCK)), lambda at: F.slice(sizes, at + 1, F.lit(BLOCK)))
    starts = running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v)), F.lit(0))
    return F.flatten(F.zip_with(blocks, starts, running))


def _score(kind: str, span: Column, near: Column) -> Column:
    valid = F.lit(VALID_SCORE)
    sure = {"iban": f"^(?:{KNOWN_COUNTRIES})", "secret": f"^(?:{KEY_PREFIXES})"}
    if kind in sure:
        valid = F.when(F.regexp_like(span, F.lit(sure[kind])), VALID_SCORE).otherwise(UNSURE_SCORE)
    return valid + F.when(near, CONTEXT_SCORE).otherwise(0)


def _accepted(kind: str, parts: Column, before: Column) -> Column:
    """Spans that are confirmed and, for an added kind, reach the least score: start, end, near, score."""

    def row(k: Column) -> Column:
        left, span, right = (F.get(parts, 2 * k + i) for i in range(3))
        start = F.get(before, k) + F.length(left)
        around = F.lower(F.concat(F.right(left, F.lit(CONTEXT_WIDTH)), F.lit(" "), F.left(right, F.lit(CONTEXT_WIDTH))))
        near = F.regexp_like(around, F.lit(CONTEXT_WORDS[kind]))
        return F.struct(span.alias("span"), start.alias("start"), (start + F.length(span)).alias("end"), near.alias("near"))

    numbers = F.filter(F.sequence(F.lit(0), _count(parts)), lambda k: (k < _count(parts)) & _confirmed(kind, F.get(parts, 2 * k + 1)))
    scored = F.transform(F.transform(numbers, row), lambda s: F.struct(s["start"], s["end"], s["near"], _score(kind, s["span"], s["near"]).alias("score")))
    return scored if kind in BASE_KINDS else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)


def _with_spans(held: DataFrame) -> DataFrame:
    """held, which has the columns text and row, with an array of spans for each kind; in steps, so that no step is made twice."""
    cut = held.select("row", "text", *[_parts(k, F.col("text")).alias(f"parts_{k}") for k in PATTERNS])

    def sizes(parts: str) -> Column:
        lengths = lambda k: F.length(F.get(parts, 2 * k)) + F.length(F.get(parts, 2 * k + 1))
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), _count(F.col(parts)) - 1), lengths)).otherwise(F.expr("cast(array() as array<int>)"))

    cut = cut.select("*", *[sizes(f"parts_{k}").alias(f"sizes_{k}") for k in PATTERNS])
    cut = cut.select("*", *[_before(F.col(f"sizes_{k}")).alias(f"before_{k}") for k in PATTERNS])
    return cut.select("row", "text", *[_accepted(k, F.col(f"parts_{k}"), F.col(f"before_{k}")).alias(k) for k in PATTERNS])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, an array of accepted spans with start, end, near and score."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return _with_spans(docs.select(F.col("doc_id").cast("long").alias("row"), text.alias("text"))).select(F.col("row").alias("doc_id"), *PATTERNS)


def _listed(kinds, shown) -> Column:
    def each(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: shown(kind, s))

    return F.array_join(F.concat(*[each(k) for k in kinds]), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, of spans of all kinds, scores
    (in hundredths, in the same order), n_spans and n_near (spans with a context word)."""
    found = find_spans(docs)

    def place(kind: str, s: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))

    near = sum((F.size(F.filter(F.col(k), lambda s: s["near"])) for k in PATTERNS), F.lit(0))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listed(BASE_KINDS, place).cast("binary"), 256).alias("base_sha256"),
        _listed(PATTERNS, place).alias("spans"),
        _listed(PATTERNS, lambda _, s: s["score"].cast("string")).alias("scores"),
        sum((F.size(k) for k in PATTERNS), F.lit(0)).cast("long").alias("n_spans"),
        near.cast("long").alias("n_near"),
    )


def redact(docs: DataFrame, mask: str = "[{kind}]") -> DataFrame:
    """docs with each accepted span of every kind replaced in text; all columns stay.

    Spans of different kinds may overlap; the one that starts first, then the longer, is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = _with_spans(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text")))

    def masked(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(mask.format(kind=kind)).alias("mask")))

    def add(done: Column, s: Column) -> Column:
        one = F.struct(done["at"].alias("from"), s["start"].alias("start"), s["mask"].alias("mask"))
        next_ = F.struct((-s["back"]).alias("at"), F.concat(done["kept"], F.array(one)).alias("kept"))
        return F.when(s["start"] >= done["at"], next_).otherwise(done)

    none = F.expr("cast(array() as array<struct<from:int,start:int,mask:string>>)")
    chosen = F.aggregate(F.array_sort(F.concat(*[masked(k) for k in PATTERNS])), F.struct(F.lit(0).alias("at"), none.alias("kept")), add)
    held = held.select("row", "text", chosen.alias("chosen"))
    pieces = F.transform("chosen.kept", lambda s: F.concat(F.substring(F.col("text"), s["from"] + 1, s["start"] - s["from"]), s["mask"]))
    left = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.col("chosen.at") + 1, F.length("text")))
    return held.select(*[left.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
