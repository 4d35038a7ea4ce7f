"""The SQL of those queries that SQL can express, for the test engine."""

from __future__ import annotations

from .licenses import TEMPLATES

# Fixed values of the contract and of the entropy spans, stated here anew.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
BASE64_RUN, HEX_RUN = "[A-Za-z0-9+/_=-]{20,}", "[0-9a-fA-F]{20,}"
BASE64_BITS, HEX_BITS = 3.55, 2.95
ALLOWED = ["^[^0-9]*$", "^[0-9_=+/-]*$", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "(?i)0123456789|abcdefghij|example", "^/?([a-z]+[0-9]{0,4}[/_-]){2,}[a-z]*[0-9]{0,4}$"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda p: array_to_string(w[p:p + 2], ' '))) AS g FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS t FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.t)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.t) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, g FROM (SELECT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM i)),
ks AS (SELECT DISTINCT k FROM iw),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks),
h AS (SELECT DISTINCT doc_id, p, dw.k, item_id FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM dp) dw JOIN iw ON iw.k = dw.k AND iw.g = dw.g),
q AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(q.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(q.n, 0) > 0 AS contaminated FROM d LEFT JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _found(name: str, pattern: str, kind: int) -> str:
    p = pattern.replace("'", "''")
    return f"""{name}0 AS (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')),
{name} AS (SELECT doc_id, {kind} AS kind, m[i] AS x, CAST(list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}0))"""


def _suppressed() -> str:
    """Without the rule for one repeated character, which the first two rules cover here."""
    return " OR ".join(f"regexp_matches(x, '{p}')" for p in ALLOWED)


ENTROPY = "round(list_max(list_transform(range(1, greatest(length(x) - 19, 1) + 1), lambda p: list_entropy(string_split(substr(x, p, 20), '')))), 6)"
NAMES = "'assign', 'access', 'hex', 'entropy'"
JOINED = f"coalesce(string_agg([{NAMES}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind){{0}}, '')"
ASSIGN2 = ASSIGN.replace("'", "''")
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("fa", ASSIGN, 0)},
{_found("fk", ACCESS, 1)},
{_found("fh", HEX, 2)},
{_found("fb", BASE64_RUN, 3)},
{_found("fx", HEX_RUN, 3)},
base AS (SELECT doc_id, kind, s, s + length(x) AS e FROM (SELECT * FROM fa WHERE length(regexp_extract(x, '{ASSIGN2}', 2)) >= 8 UNION ALL SELECT * FROM fk UNION ALL SELECT * FROM fh)),
more AS (SELECT DISTINCT doc_id, kind, s, s + length(x) AS e FROM (SELECT *, {BASE64_BITS} AS bits FROM fb UNION ALL SELECT *, {HEX_BITS} FROM fx) WHERE NOT ({_suppressed()}) AND {ENTROPY} >= bits),
spans AS (SELECT *, true AS b FROM base UNION ALL SELECT *, false FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.s <= m.s AND b.e >= m.e))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256({JOINED.format(" FILTER (b)")}) AS base_sha256, {JOINED.format("")} AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Weight and divergence in integers, over all terms of all groups: no part of it goes by counts or bands.
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({FOLDED}, '{TERM}') AS w FROM documents),
e AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM e GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM a GROUP BY 1, 2),
p AS (SELECT a.lang, a.source, a.term, a.n, 1 + CAST(1000000000 AS HUGEINT) * (a.n + 1) // (s.total + v.v) AS p FROM a JOIN s ON s.lang = a.lang AND s.source = a.source JOIN v ON v.lang = a.lang),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
lp AS (SELECT l.lang, l.term, 1 + CAST(1000000000 AS HUGEINT) * (l.n + 1) // (t.total + v.v) AS q FROM l JOIN (SELECT lang, sum(n) AS total FROM l GROUP BY 1) t ON t.lang = l.lang JOIN v ON v.lang = l.lang),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - lp.q) * (p.p - lp.q) // lp.q AS value FROM p JOIN lp ON lp.lang = p.lang AND lp.term = p.term WHERE p.n > 0 AND p.p > lp.q),
o AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
k2 AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM k2 WHERE part = 'pair' OR rank <= 200"""

# Fixed values of the contract's phrases; the notices are those of the operator, as the data that it is given.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))


def _op13() -> str:
    def line(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    given = ", ".join(f"({i}, {line(a)}, {line(b)}, {e})" for i, (a, b, e) in enumerate([(*x, "true") for x in PHRASES] + [(*x, "false") for x in TEMPLATES]))
    grams = "unnest(range(0, len(w) - {k} + 1)) AS t, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS gram"
    cover = "len(list_distinct(flatten(list_transform({0}, lambda t: range(t, t + n)))))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM documents),
given(t_id, label, text, exact) AS (VALUES {given}),
tw AS (SELECT t_id, label, exact, regexp_extract_all({FOLDED}, '{WORD}') AS w FROM given),
ts AS (SELECT *, len(w) AS size, least(len(w), 3) AS n FROM tw),
tg AS (SELECT t_id, label, exact, size, n, {grams.format(k="n")} FROM ts),
dg AS (SELECT r, n, {grams.format(k="n")} FROM (SELECT d.*, n FROM d, (SELECT DISTINCT n FROM ts) WHERE len(w) >= n)),
h AS (SELECT DISTINCT dg.r, tg.t_id, label, exact, size, tg.n, dg.t - tg.t AS dia, tg.t FROM dg JOIN tg ON tg.n = dg.n AND tg.gram = dg.gram),
b AS (SELECT *, unnest(CASE WHEN exact THEN [0] ELSE [0, 1, 2] END) AS level, greatest(size // 8, 1) AS drift FROM h),
m AS (SELECT r, t_id, label, exact, size, n, level, list(DISTINCT t) AS tt, list(DISTINCT dia + t) AS aa FROM b GROUP BY r, t_id, label, exact, size, n, level, CASE level WHEN 0 THEN dia ELSE CAST(floor((dia + (level - 1) * drift) / (2 * drift)) AS BIGINT) END),
c AS (SELECT *, {cover.format("tt")} AS hit, {cover.format("aa")} AS within, list_min(aa) AS s, list_max(aa) + n AS e FROM m),
x AS (SELECT DISTINCT r, t_id, label, exact, size, s, e, hit, CAST(hit AS DOUBLE) / size AS score FROM c WHERE (exact AND len(tt) = size - n + 1) OR (NOT exact AND hit >= 0.7 * size AND within >= 0.7 * (e - s))),
y AS (SELECT * FROM x a WHERE exact OR NOT EXISTS (SELECT 1 FROM x o WHERE o.r = a.r AND NOT o.exact AND (o.score, o.hit, -o.t_id, -o.s, -o.e) > (a.score, a.hit, -a.t_id, -a.s, -a.e) AND 2 * (least(o.e, a.e) - greatest(o.s, a.s)) >= a.e - a.s))
SELECT d.doc_id, any_value(len(w)) AS n_words, count(*) FILTER (exact) AS n_base, min(s) FILTER (exact) AS first_word, max(s) FILTER (exact) AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(CASE WHEN exact THEN 1.0 ELSE score END), 0.0) AS score
FROM d LEFT JOIN y ON y.r = d.r GROUP BY d.r, d.doc_id"""


ORACLE_SQL = {"op1_ngram_jaccard_join": OP1, "op8_secret_scans": OP8, "op10_benchmark_decontamination": OP10, "op12_source_divergence": OP12, "op13_license_scans": _op13()}
