"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from provark.llm.queries import LISTED_SITES, RULES
from provark.llm.secret_scan import ACCESS, ASSIGN, ENDPOINT, HEX, OPAQUE

_lit = lambda s: "'" + s.replace("'", "''") + "'"

OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""

OP4 = f"""
WITH rules(rhost, rpath, judged) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
p0 AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '') AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, {_lit(LISTED_SITES)})),
best AS (SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(judged, length(rhost || rpath)) AS judged
         FROM (SELECT DISTINCT host, path FROM c) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, c.host, c.path, rule, coalesce(judged, CASE WHEN l.canonical IS NOT NULL AND c.host <> '' THEN 'block' ELSE 'allow' END) AS verdict,
       l.canonical IS NOT NULL AND c.host <> '' AS listed
FROM c LEFT JOIN best b ON c.host = b.host AND c.path = b.path LEFT JOIN listed l ON c.canonical = l.canonical
""".replace("\\\\", "\\")


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hit AS (SELECT r, t, unnest([
  {{'o': 0, 'f': regexp_extract_all(t, {_lit(ASSIGN)}, 0), 'b': string_split_regex(t, {_lit(ASSIGN)})}},
  {{'o': 1, 'f': regexp_extract_all(t, {_lit(ACCESS)}, 0), 'b': string_split_regex(t, {_lit(ACCESS)})}},
  {{'o': 2, 'f': regexp_extract_all(t, {_lit(HEX)}, 0), 'b': string_split_regex(t, {_lit(HEX)})}},
  {{'o': 3, 'f': regexp_extract_all(t, {_lit(OPAQUE)}, 0), 'b': string_split_regex(t, {_lit(OPAQUE)})}},
  {{'o': 4, 'f': regexp_extract_all(t, {_lit(ENDPOINT)}, 0), 'b': string_split_regex(t, {_lit(ENDPOINT)})}}]) AS h FROM d),
one AS (SELECT r, h.o AS o, unnest(h.f) AS m, unnest(h.b[:len(h.f)]) AS b, generate_subscripts(h.f, 1) AS i FROM hit),
pos AS (SELECT r, o, m, (sum(length(b) + length(m)) OVER (PARTITION BY r, o ORDER BY i) - length(m))::BIGINT AS s FROM one),
span AS (SELECT r, o, s, s + length(m) AS e FROM pos WHERE
  (o = 0 AND length(regexp_extract(m, {_lit(ASSIGN)}, 2)) >= 6) OR (o = 1 AND length(m) >= 20) OR (o = 2 AND length(m) >= 24)
  OR (o = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')) OR o = 4),
free AS (SELECT * FROM span w WHERE o >= 3 AND NOT EXISTS (SELECT 1 FROM span b WHERE b.r = w.r AND b.o < 3 AND b.s < w.e AND w.s < b.e)),
part AS (SELECT * FROM span WHERE o < 3 UNION ALL SELECT * FROM free),
linked AS (SELECT * FROM free w WHERE EXISTS (SELECT 1 FROM part a WHERE a.r = w.r AND abs(a.s - w.s) <= 200
  AND ((w.o = 3 AND a.o IN (1, 4)) OR (w.o = 4 AND a.o < 4)))),
kept AS (SELECT r, o, s, e, ['assign', 'access', 'hex', 'secret', 'endpoint'][o + 1] || ':' || s || ':' || e AS txt FROM (SELECT * FROM span WHERE o < 3 UNION ALL SELECT * FROM linked)),
agg AS (SELECT r, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, count(*) FILTER (o > 2) AS n3,
  string_agg(txt, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(txt, ',' ORDER BY s, o) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n3, 0) AS n_linked
FROM d LEFT JOIN agg USING (r)
"""

#: The table of crc32 is folded from its polynomial, a digit's byte at a time.
OP11 = """
WITH t AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v::BIGINT, range(8)), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
s AS (SELECT sale_id, (floor(epoch(sold_at) / 60))::BIGINT AS slot, (floor(floor(100 * total + 0.5) / 1))::BIGINT AS level,
             1 + coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                     lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295) % 5, 0) AS w FROM sales, t),
g AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
a AS (SELECT q.slot, q.level, sum(p.n) AS n, sum(p.w) AS w FROM g q JOIN g p ON p.slot < q.slot AND p.level > q.level GROUP BY ALL)
SELECT sale_id, s.slot, s.level, CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(n, 0)::BIGINT END AS n_sales,
       CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(a.w, 0)::BIGINT END AS n_rows
FROM s LEFT JOIN a ON s.slot = a.slot AND s.level = a.level
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
cut AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win))),
occ AS (SELECT r, k, cut.n, item FROM cut JOIN win ON cut.g = win.g AND cut.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM occ) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

ORACLES = {"op12_decontamination": OP12, "op11_dominance": OP11, "op3_exact_dedup": OP3, "op4_url_filter": OP4, "op6_secret_scan": OP6}
