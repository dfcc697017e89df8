"""SQL, for DuckDB, that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from . import decontaminate, licenses, lm, secrets


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE
        WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def _spans(k: int, rule: secrets.Rule) -> str:
    pattern = _text(rule.pattern)
    return f"""
    SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, e - len(m) AS start, e FROM (
        SELECT doc_id, m[i] AS m, g[i] AS g, list_sum(list_transform(p[1:i], lambda x: len(x))) + list_sum(list_transform(m[1:i], lambda x: len(x))) AS e FROM (
            SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {rule.group}) AS g, regexp_split_to_array(t, {pattern}) AS p FROM d
            ))) WHERE len(g) >= {rule.least}"""


def _joined(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY start, k) FILTER (WHERE {where}), '')"


_BASE = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(secrets.RULES))})
SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)},
    sha256({_joined(f"kind IN ({_BASE})")}) AS base_sha256, {_joined("kind IS NOT NULL")} AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""

_ALNUM = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '')"
_GRAMS = "list_distinct(list_transform(range(1, len(w) - span + 2), lambda i: array_to_string(w[i:i + span - 1], ' ')))"
DECONTAMINATION = f"""
WITH items AS (SELECT item_id, span, {_GRAMS} AS grams FROM (SELECT item_id, w, least({decontaminate.WORDS}, len(w)) AS span FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark)) WHERE span > 0),
grams AS (SELECT item_id, span, len(grams) AS size, unnest(grams) AS g FROM items),
docs AS (SELECT doc_id, span, unnest({_GRAMS}) AS g FROM (SELECT doc_id, {_ALNUM} AS w FROM documents) JOIN (SELECT DISTINCT span FROM items) ON len(w) >= span)
SELECT doc_id, item_id, count(DISTINCT g) AS shared, count(DISTINCT g) / CAST(size AS DOUBLE) AS containment
FROM docs JOIN grams USING (span, g) GROUP BY doc_id, item_id, size HAVING count(DISTINCT g) >= ceil(round({decontaminate.THRESHOLD} * size, 9))
"""

_TERMS, _IDF, _UNSEEN = licenses.template_terms(licenses.TEMPLATES)
LICENSES = f"""
WITH terms(template, license, term, weight) AS (VALUES {", ".join(f"({k}, {_text(n)}, {_text(t)}, {w!r}::DOUBLE)" for k, n, t, w in _TERMS)}),
idf(term, idf) AS (VALUES {", ".join(f"({_text(t)}, {w!r}::DOUBLE)" for t, w in sorted(_IDF.items()))}),
files AS (SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') AS folder, coalesce(source, '_') AS above, text FROM documents),
parts AS (
    SELECT DISTINCT doc_id, folder, unit, unit = trim(text) AS whole FROM (
        SELECT doc_id, folder, text, trim(unnest(list_filter(list_concat(
            regexp_split_to_array(text, '\\n[\\x20\\t\\r]*\\n'), string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?])[\\x20\\t\\r]+', '\\1' || chr(10), 'g'), chr(10))
        ), lambda x: regexp_matches(x, {_text(licenses.CUE)})))) AS unit FROM files WHERE regexp_matches(text, {_text(licenses.CUE)}))
),
tf AS (SELECT unit, term, count(*) AS n FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), {_text(licenses.TERM.replace('*+', '*'))})) AS term FROM (SELECT DISTINCT unit FROM parts)) GROUP BY ALL),
w AS (SELECT unit, term, (1 + ln(n)) * coalesce(idf, {_UNSEEN!r}::DOUBLE) AS w FROM tf LEFT JOIN idf USING (term)),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit),
scored AS (SELECT unit, license, round(sum(w * weight) / any_value(norm), 6) AS s FROM w JOIN terms USING (term) JOIN norms USING (unit) GROUP BY unit, template, license),
found AS (SELECT doc_id, folder, whole, license, s FROM parts JOIN scored USING (unit) WHERE s >= {licenses.LEAST}),
own AS (SELECT doc_id, license, s FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, license) = 1),
given AS (SELECT folder, license, s FROM found WHERE whole QUALIFY row_number() OVER (PARTITION BY folder ORDER BY s DESC, license) = 1)
SELECT f.doc_id, f.folder || '/' || f.doc_id AS path, coalesce(o.license, g.license) AS license,
    CASE WHEN o.license IS NOT NULL THEN 'own' WHEN g.license IS NOT NULL THEN 'inherited' END AS basis, coalesce(o.s, g.s) AS similarity,
    CASE WHEN o.license IS NULL THEN g.folder END AS directory
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN given g ON g.folder = f.folder
"""

LM = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
one AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
total AS (SELECT sum(n) AS n FROM one),
occ AS MATERIALIZED (SELECT doc_id, CASE WHEN i > 2 THEN w[i - 2] END AS o, CASE WHEN i > 1 THEN w[i - 1] END AS p, w[i] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
two AS (SELECT p, w, count(*) AS n FROM occ WHERE p IS NOT NULL GROUP BY ALL),
three AS (SELECT o, p, w, count(*) AS n FROM occ WHERE o IS NOT NULL GROUP BY ALL),
scored AS (
    SELECT doc_id, CASE
        WHEN three.n >= {lm.MIN_COUNT} THEN ln(three.n / before.n)
        WHEN c.p IS NULL THEN ln(b.n / total.n)
        WHEN two.n >= {lm.MIN_COUNT} THEN ln(CASE WHEN c.o IS NULL THEN 1 ELSE {lm.ALPHA} END * two.n / a.n)
        ELSE ln(CASE WHEN c.o IS NULL THEN 1 ELSE {lm.ALPHA} END * {lm.ALPHA} * b.n / total.n) END AS s
    FROM occ c JOIN one b ON b.w = c.w LEFT JOIN one a ON a.w = c.p LEFT JOIN two ON two.p = c.p AND two.w = c.w
        LEFT JOIN two before ON before.p = c.o AND before.w = c.p LEFT JOIN three ON three.o = c.o AND three.p = c.p AND three.w = c.w CROSS JOIN total
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s.score, 0), 4) AS score, round(CASE WHEN len(w) > 0 THEN exp(-s.score / len(w)) END, 2) AS perplexity
FROM d LEFT JOIN (SELECT doc_id, sum(s) AS score FROM scored GROUP BY doc_id) s USING (doc_id)
"""
