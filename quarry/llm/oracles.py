"""DuckDB SQL of the llm queries that SQL can express; each is a plain formulation, not the method."""

from __future__ import annotations

from .secret_scan import BASE, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _linked(words: int, percent: int, columns: str) -> str:
    """Components of the documents whose sets of shingles are similar, by all pairs that share one."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM w UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.other),
top AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, {columns} FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN top ON top.id = w.doc_id
"""


NEAR_DUP = _linked(3, 85, "component_id, w.doc_id = component_id AS kept")
OVERLAP_JOIN = _linked(5, 80, "component_id")

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH iw AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g FROM iw, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, dg.n, item FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hit GROUP BY doc_id)
SELECT dw.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cover ON cover.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id
"""


def _rule(place: int) -> str:
    r = RULES[place]
    pattern = r.pattern.replace("'", "''")
    return (
        f"SELECT doc_id, '{r.kind}' AS kind, {place} AS place, {r.least} AS least, regexp_split_to_array(t, '{pattern}') AS p, "
        f"regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS v FROM d"
    )


SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_rule(k) for k in range(len(RULES)))}),
e AS (SELECT doc_id, kind, place, least, k, length(p[k]) AS gap, length(m[k]) AS size, length(v[k]) AS val FROM m, unnest(range(1, len(m) + 1)) AS t(k)),
s AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM e),
f AS (SELECT doc_id, kind, place, stop - size AS start, kind || ':' || cast(stop - size AS bigint) || ':' || cast(stop AS bigint) AS span FROM s WHERE val >= least),
g AS (SELECT doc_id, string_agg(span, ',' ORDER BY start, place) AS spans, coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place < {len(BASE)}), '') AS base,
  {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)} FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || cast(doc_id AS varchar)) AS h FROM documents),
x AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform(range(4), lambda k: cast('0x' || substr(h, cast(8 * k + 1 AS bigint), 8) AS bigint)) AS h FROM d),
c AS (SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(w[:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p
"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g, count(*) AS f FROM w, unnest([1, 2, 3, 4]) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, g, m, f AS a, string_split(g, ' ') AS w FROM g WHERE m > 1 AND f >= 30),
k AS (SELECT c.lang, c.g, c.m, a, k, x.f AS l, y.f AS r, cast(2000000 AS hugeint) * a // (x.f + y.f) AS score FROM c, unnest(range(1, c.m)) AS t(k)
  JOIN g x ON x.lang = c.lang AND x.m = k AND x.g = array_to_string(c.w[:k], ' ') JOIN g y ON y.lang = c.lang AND y.m = c.m - k AND y.g = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS g, max(a) AS around FROM c, unnest(range(2, m)) AS u(s), unnest(range(1, m - s + 2)) AS t(i) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inner_ i ON i.lang = b.lang AND i.g = b.g WHERE around IS NULL OR 100 * cast(around AS hugeint) < 80 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT r.lang, rank, g AS phrase, a, l, r, cast(n AS bigint) AS n, cast(score AS bigint) AS score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""

#: Katz of order 2 with the discounts of a line through the logarithms of the counts of counts, as a join of plain tables.
#: ' ' stands for the end of a text and '  ' for its beginning: no word has a space.
KATZ = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS (SELECT doc_id, text, list_transform(range(1, length(cast(doc_id AS varchar)) + 1), lambda i: cast(ascii(cast(doc_id AS varchar)[i]) AS bigint)) AS b FROM documents),
d AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 1 AS held_out, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), ' ') AS w FROM ids, crc),
tok AS (SELECT doc_id, held_out, w[i] AS w, CASE WHEN i = 1 THEN '  ' ELSE w[i - 1] END AS h FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
c1 AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w), c2 AS (SELECT h, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY h, w),
size AS (SELECT sum(c) AS n, count(*) AS v FROM c1),
cc AS (SELECT 1 AS m, c AS r, count(*) AS n FROM c1 WHERE c <= 12 GROUP BY c UNION ALL SELECT 2, c, count(*) FROM c2 WHERE c <= 12 GROUP BY c),
gap AS (SELECT m, r, n, lag(r, 1, 0) OVER o AS q, lead(r) OVER o AS t FROM cc WINDOW o AS (PARTITION BY m ORDER BY r)),
fit AS (SELECT m, regr_slope(ln(n * 2.0 / (coalesce(t, 2 * r - q) - q)), ln(r)) + 1 AS e FROM gap GROUP BY m),
lost AS (SELECT m, r, (1 - power(1 + 1.0 / r, e)) / (1 - power(6.0, e)) AS x FROM fit, unnest(range(1, 6)) AS t(r)),
p1 AS (SELECT w, c, coalesce(x, 1e-6) AS x, (1 - coalesce(x, 1e-6)) * c / n AS p FROM c1 LEFT JOIN lost ON m = 1 AND r = c, size),
unk AS (SELECT sum(x * c) / any_value(n) AS u FROM p1, size),
p2 AS (SELECT h, w, c, coalesce(x, 1e-6) AS x FROM c2 LEFT JOIN lost ON m = 2 AND r = c),
hist AS (SELECT h, sum(p2.c) AS n, sum(p2.x * p2.c) / sum(p2.c) / (1 - sum(p)) AS alpha FROM p2 JOIN p1 ON p2.w = p1.w GROUP BY h),
s AS (SELECT doc_id, p1.c IS NOT NULL AS known, log10((coalesce(p1.c, 0) + 0.5) / (size.n + 0.5 * (v + 1))) AS base,
  log10(CASE WHEN p2.c IS NOT NULL THEN (1 - p2.x) * p2.c / hist.n WHEN hist.n IS NOT NULL THEN alpha * coalesce(p, u) ELSE coalesce(p, u) END) AS score
  FROM tok LEFT JOIN p1 ON tok.w = p1.w LEFT JOIN p2 ON tok.h = p2.h AND tok.w = p2.w LEFT JOIN hist ON tok.h = hist.h, size, unk),
g AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, round(sum(base), 6) AS base_score, round(sum(score), 6) AS score FROM s GROUP BY doc_id)
SELECT g.doc_id, held_out, n_tokens, n_known, cast(size.n AS bigint) AS train_tokens, base_score, score, (SELECT string_agg(CASE WHEN e < 0 THEN 'good-turing' ELSE 'absolute' END, ',' ORDER BY m) FROM fit) AS smoothing
FROM g JOIN d ON d.doc_id = g.doc_id, size
"""
