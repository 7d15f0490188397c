"""DuckDB SQL for the queries of this subpackage that SQL can express.

Fingerprints (XXH64), tokenizers, fitted models, packing and graph search aren't in DuckDB's
dialect; those queries are tested against brute force instead.
"""

from __future__ import annotations

from .decontamination import SLOP, WIDTH
from .pii import BASE_KINDS, CONTEXT_SCORE, CONTEXT_WIDTH, CONTEXT_WORDS, KEY_PREFIXES, LEAST_SCORE, UNSURE_SCORE, VALID_SCORE
from .url_filter import BLOCKED_SITES, RULES

_WORDS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w AS item_w, list_slice(w, k + 1, k + {WIDTH}) AS g FROM (SELECT item, w, unnest(range(greatest(len(w) - {WIDTH}, 0) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
spots AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT doc_id, item, item_w, k, n FROM (SELECT doc_id, k, n, list_slice(w, k + 1, k + n) AS g FROM spots) JOIN win USING (g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM occ) GROUP BY 1),
placed AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM d),
counts AS (SELECT term, count(*) AS n FROM placed GROUP BY 1),
terms AS (SELECT item, w, k, spot, w[spot + 1] AS term FROM (SELECT item, w, k, unnest(range(k, k + least(len(w), {WIDTH}))) AS spot FROM
 (SELECT item, w, unnest(range(greatest(len(w) - {WIDTH}, 0) + 1)) AS k FROM b WHERE len(w) > 0))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item, w, k ORDER BY n, spot) AS r FROM
 (SELECT *, min(n) OVER (PARTITION BY item, w, k) AS least FROM (SELECT terms.*, coalesce(n, 0) AS n FROM terms LEFT JOIN counts USING (term))) WHERE least > 0),
anchors AS (SELECT item, w, k, min(spot) AS at1, max(spot) AS at2, arg_min(term, spot) AS t1, arg_max(term, spot) AS t2 FROM ranked WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT x.doc_id, item, w FROM (SELECT DISTINCT item, w, at2 - at1 AS gap, t1, t2 FROM anchors) JOIN placed x ON x.term = t1
 JOIN placed y ON y.doc_id = x.doc_id AND y.term = t2 AND y.p - x.p - gap BETWEEN -{SLOP} AND {SLOP} AND y.p - x.p <> gap) n
 ANTI JOIN (SELECT DISTINCT doc_id, item, w FROM (SELECT doc_id, item, item_w AS w FROM occ)) o USING (doc_id, item, w) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""

PREFERENCE = """WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
 coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
 FROM conversations WHERE conv_id IS NOT NULL),
pairs AS (SELECT pair_id, min(conv_id) FILTER (side = 'chosen') AS chosen_id, min(conv_id) FILTER (side = 'rejected') AS rejected_id FROM t GROUP BY 1
 HAVING count(DISTINCT side) = 2),
sizes AS (SELECT conv_id, max(k) AS n FROM t GROUP BY 1),
gaps AS (SELECT p.pair_id, min(a.k) AS gap FROM pairs p JOIN t a ON a.conv_id = p.chosen_id JOIN t b ON b.conv_id = p.rejected_id AND a.k = b.k
 WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1),
common AS (SELECT p.*, coalesce(gap - 1, least(x.n, y.n))::BIGINT AS n_common FROM pairs p LEFT JOIN gaps USING (pair_id)
 JOIN sizes x ON x.conv_id = chosen_id JOIN sizes y ON y.conv_id = rejected_id),
turns AS (SELECT c.pair_id, t.side, t.k, t.role, c.n_common, '<|' || t.role || '|>' || chr(10) || t.text || chr(10) AS shown, length(t.role) + 5 AS lead, length(t.text) AS size
 FROM common c JOIN t ON t.pair_id = c.pair_id),
placed AS (SELECT *, sum(lead + size + 1) OVER (PARTITION BY pair_id, side ORDER BY k) - size - 1 AS start FROM turns WHERE k > n_common),
rest AS (SELECT pair_id, side, string_agg(shown, '' ORDER BY k) AS shown,
 coalesce(string_agg(start || ':' || (start + size), ',' ORDER BY k) FILTER (role = 'assistant'), '') AS mask FROM placed GROUP BY 1, 2),
prompts AS (SELECT pair_id, string_agg(shown, '' ORDER BY k) AS prompt FROM turns WHERE k <= n_common AND side = 'chosen' GROUP BY 1)
SELECT pair_id, chosen_id, rejected_id, n_common, coalesce(prompt, '') AS prompt, coalesce(x.shown, '') AS chosen, coalesce(y.shown, '') AS rejected,
 coalesce(x.mask, '') AS chosen_mask, coalesce(y.mask, '') AS rejected_mask FROM common LEFT JOIN prompts USING (pair_id)
 LEFT JOIN (SELECT * FROM rest WHERE side = 'chosen') x USING (pair_id) LEFT JOIN (SELECT * FROM rest WHERE side = 'rejected') y USING (pair_id)"""

_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
_SITE_ROWS = ", ".join(f"('{s}')" for s in BLOCKED_SITES)

URL_FILTER = rf"""WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT page_id, r.host || r.path AS rule, action FROM u JOIN (VALUES {_RULE_ROWS}) r(action, host, path)
 ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1),
sites AS (SELECT DISTINCT page_id FROM u JOIN (VALUES {_SITE_ROWS}) s(site) ON u.host = site OR ends_with(u.host, '.' || site))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN s.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits USING (page_id) LEFT JOIN sites s USING (page_id)"""

#: The contract's patterns and the one for keys; account numbers need look-around.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"[A-Za-z0-9_-]{20,}",
}
_DIGITS = "regexp_replace(span, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum([CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT
 ELSE substr(reverse({_DIGITS}), i, 1)::INT * 2 - CASE WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN 9 ELSE 0 END END FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"""
_CHECKS = {
    "email": "true",
    "ip": "len([x FOR x IN string_split(span, '.') IF length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255')]) = 0",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "secret": "regexp_matches(span, '[0-9]') AND regexp_matches(span, '[A-Za-z]')",
}


def _pii() -> str:
    each = []
    for order, (kind, pattern) in enumerate(_SQL_PATTERNS.items()):
        valid = f"CASE WHEN regexp_matches(span, '^(?:{KEY_PREFIXES})') THEN {VALID_SCORE} ELSE {UNSURE_SCORE} END" if kind == "secret" else str(VALID_SCORE)
        each.append(f"""SELECT * FROM (SELECT *, {valid} + CASE WHEN near THEN {CONTEXT_SCORE} ELSE 0 END AS score FROM (
 SELECT doc_id, row_no, {order} AS o, '{kind}' AS kind, span, start, stop, regexp_matches(lower(right(before, {CONTEXT_WIDTH}) || ' ' || left(after, {CONTEXT_WIDTH})), '{CONTEXT_WORDS[kind]}') AS near FROM (
 SELECT doc_id, row_no, f[k] AS span, p[k] AS before, p[k + 1] AS after, list_sum([length(x) FOR x IN p[1:k]]) + coalesce(list_sum([length(x) FOR x IN f[1:k - 1]]), 0) AS start,
 list_sum([length(x) FOR x IN p[1:k]]) + list_sum([length(x) FOR x IN f[1:k]]) AS stop FROM (
 SELECT doc_id, row_no, f, p, unnest(range(1, len(f) + 1)) AS k FROM (
 SELECT doc_id, row_no, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS p FROM d))) WHERE {_CHECKS[kind]})) WHERE score >= {0 if kind in BASE_KINDS else LEAST_SCORE}""")
    union = "\nUNION ALL\n".join(each)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    shown = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)
    place = "kind || ':' || start || ':' || stop, ',' ORDER BY o, start"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents), s AS ({union}),
g AS (SELECT row_no, {counts}, string_agg({place}) FILTER (o < {len(BASE_KINDS)}) AS base, string_agg({place}) AS listed, string_agg(score::VARCHAR, ',' ORDER BY o, start) AS scores,
 count(*) AS n_spans, count(*) FILTER (near) AS n_near FROM s GROUP BY 1)
SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(listed, '') AS spans, coalesce(scores, '') AS scores,
 coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(n_near, 0)::BIGINT AS n_near FROM d LEFT JOIN g USING (row_no)"""


_WHOLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"

HARD_NEGATIVES = f"""WITH held AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_WHOLE}),
scored AS (SELECT a.u AS au, a.vec_id AS anchor_id, a.label = b.label AS same, b.u, b.vec_id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
 FROM held a JOIN held b ON a.u <> b.u WHERE a.vec_id % 100 = 0),
positive AS (SELECT au, anchor_id, u AS pu, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id, u) <= 5),
negative AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.au, p.pu ORDER BY s.score DESC, s.vec_id, s.u) AS rank
 FROM positive p JOIN scored s ON p.au = s.au AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5"""


def _lloyd(rounds: int) -> str:
    """Rounds of assigning all parts and averaging, each a pair of tables."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, any_value(v) AS v, min(CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT) * 256 + e) AS best
 FROM parts JOIN b{k} USING (p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, o.c) AS c FROM b{k} o LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM
 (SELECT p, best % 256 AS e, i, floor(sum(v[i]) / count(*)) AS c FROM a{k}, range(1, (SELECT w + 1 FROM width)) t(i) GROUP BY ALL) GROUP BY ALL) n USING (p, e))""")
    return ",\n".join(steps)


VECTOR_CODES = f"""WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS x FROM embeddings WHERE {_WHOLE}),
held AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS r, * FROM whole),
width AS (SELECT len(any_value(x)) // 4 AS w FROM held),
parts AS MATERIALIZED (SELECT r, p, x[p * w + 1 : (p + 1) * w] AS v FROM held, width, range(4) t(p)),
b0 AS (SELECT p, r AS e, v AS c FROM parts WHERE r < 256),
{_lloyd(4)},
coded AS (SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY r),
named AS (SELECT vec_id, label, code, error FROM held JOIN coded USING (r)),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM named GROUP BY label),
books AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b4, range(1, (SELECT w + 1 FROM width)) t(i))
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM named JOIN sums ON named.label IS NOT DISTINCT FROM sums.label CROSS JOIN books"""

ORACLE_SQL: dict[str, str] = {
    # account numbers need look-around, which DuckDB's patterns lack: the test tables hold none
    "op2_pii": _pii(),
    "op3_decontamination": DECONTAMINATION,
    "op5_preference": PREFERENCE,
    "op10_url_filter": URL_FILTER,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_vector_codes": VECTOR_CODES,
}
