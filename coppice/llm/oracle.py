"""DuckDB SQL of the queries that SQL can say."""

from __future__ import annotations

from coppice.llm.url_filter import TWO_LABELS

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), b AS (
  SELECT *, row_number() OVER o AS place,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)
), f AS (
  SELECT *, cap * open_weight <= weight * left_over AS stops, CAST(left_over AS DOUBLE) / CAST(open_weight AS DOUBLE) AS rate FROM b
), t AS (
  SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * coalesce((SELECT arg_min(rate, place) FROM f WHERE NOT stops), 0.0)) END AS target FROM f
), k AS (
  SELECT d.*, length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)) % 8 AS level, ((16807 * ((coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647)) % 2147483647) % 128 AS salt FROM d
), r AS (
  SELECT k.doc_id, k.source, k.size, t.source_size, t.target, row_number() OVER (PARTITION BY k.source ORDER BY level, salt, size, doc_id) AS rank,
    CAST(('0x' || substr(md5('7:' || coalesce('s' || k.source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS shift,
    CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
  CAST(floor(rank * rate + shift) - floor((rank - 1) * rate + shift) AS BIGINT) AS copies,
  CAST(size * (floor(rank * rate + shift) - floor((rank - 1) * rate + shift)) AS BIGINT) AS taken
FROM r
"""

OP9 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), o AS (
  SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad
  FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})', 1), '') AS BIGINT) AS doc_id FROM q) JOIN labels USING (doc_id)
), h AS (
  SELECT host, string_split(host, '.') AS parts, len(string_split(host, '.')) AS np FROM (SELECT DISTINCT host FROM q)
), h2 AS (
  SELECT *, array_to_string(parts[greatest(np - 1, 1):np], '.') AS last_two, np > 2 AND array_to_string(parts[greatest(np - 1, 1):np], '.') IN (TWO_LABELS) AS two FROM h
), k AS (
  SELECT h2.host, coalesce(c.n, 0) AS n, coalesce(c.bad, 0) AS bad, 
    CASE WHEN two THEN last_two ELSE parts[-1] END AS suffix, CASE WHEN two THEN array_to_string(parts[greatest(np - 2, 1):np], '.') ELSE last_two END AS domain
  FROM h2 LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS bad FROM o GROUP BY host) c USING (host)
), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM k GROUP BY suffix
), root AS (SELECT (sum(bad) + 0.5) / (sum(n) + 10.0) AS mean, sum(n) + 10.0 AS sure FROM s
), sr AS (
  SELECT count(*) AS seen, sum(n * (bad / n - mean) ** 2 - mean * (1 - mean)) / nullif(sum((n - 1) * mean * (1 - mean)), 0) AS rho FROM s, root WHERE n > 0
), sp AS (
  SELECT suffix, (h * mean + bad) / (h + n) AS mean, h + n AS sure
  FROM (SELECT suffix, n, bad, mean, g * sure / (g + sure) AS h FROM s, root, (SELECT CASE WHEN seen < 2 THEN 1.0 WHEN coalesce(rho, 0) <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / rho - 1)) END AS g FROM sr))
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM k GROUP BY domain, suffix
), dr AS (
  SELECT count(*) AS seen, sum(n * (bad / n - mean) ** 2 - mean * (1 - mean)) / nullif(sum((n - 1) * mean * (1 - mean)), 0) AS rho FROM d JOIN sp USING (suffix) WHERE n > 0
), dp AS (
  SELECT domain, (h * mean + bad) / (h + n) AS mean, h + n AS sure
  FROM (SELECT domain, n, bad, mean, g * sure / (g + sure) AS h FROM d JOIN sp USING (suffix), (SELECT CASE WHEN seen < 2 THEN 1.0 WHEN coalesce(rho, 0) <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / rho - 1)) END AS g FROM dr))
), hr AS (
  SELECT count(*) AS seen, sum(n * (bad / n - mean) ** 2 - mean * (1 - mean)) / nullif(sum((n - 1) * mean * (1 - mean)), 0) AS rho FROM k JOIN dp USING (domain) WHERE n > 0
), hp AS (
  SELECT host, h * mean + bad AS a, h * (1 - mean) + n - bad AS b
  FROM (SELECT host, n, bad, mean, g * sure / (g + sure) AS h FROM k JOIN dp USING (domain), (SELECT CASE WHEN seen < 2 THEN 1.0 WHEN coalesce(rho, 0) <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, 1 / rho - 1)) END AS g FROM hr))
), x AS (SELECT host, a / (a + b) AS rate, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM hp
), j AS (
  SELECT q.*, rate, bound, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM q JOIN x USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
  round(rate, 9) AS bad_rate, round(bound, 9) AS bound
FROM j
""".replace("TWO_LABELS", ", ".join(f"'{x}'" for x in TWO_LABELS))

#: CRC-32 of an ASCII text, unsigned, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

FIELD = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
LEAF = lambda n: "sha256(" + " || ".join(FIELD(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"

OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || lang, '') AS tag, {LEAF("n_chars")} AS leaf,
    {LEAF("(n_chars + CASE WHEN " + CRC.format(text="CAST(doc_id AS VARCHAR)") + " % 7 = 0 THEN 1 ELSE 0 END)")} AS claimed FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tag) AS n FROM d
), nodes AS (
  SELECT tag, 0 AS level, i, leaf AS h, n FROM l
  UNION ALL SELECT tag, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tag, level, i // 2, n
), sub AS (
  SELECT tag, h, row_number() OVER (ORDER BY tag) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, h, n FROM sub
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n
), low AS (
  SELECT l.tag, l.i, list(CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < a.i THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY a.level) AS path
  FROM l JOIN nodes a ON a.tag = l.tag AND a.n > 1 AND a.i = (l.i >> a.level) LEFT JOIN nodes s ON s.tag = a.tag AND s.level = a.level AND s.i = xor(a.i, 1) GROUP BY l.tag, l.i
), high AS (
  SELECT sub.tag, list(CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < a.i THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY a.level) AS path
  FROM sub JOIN tops a ON a.n > 1 AND a.i = (sub.i >> a.level) LEFT JOIN tops s ON s.level = a.level AND s.i = xor(a.i, 1) GROUP BY sub.tag
), p AS (
  SELECT l.doc_id, l.leaf, l.claimed, sub.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM l JOIN sub USING (tag) LEFT JOIN low ON low.tag = l.tag AND low.i = l.i LEFT JOIN high ON high.tag = l.tag
), f AS (
  SELECT *, list_reduce(list_prepend(claimed, path), lambda h, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root FROM p
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

OP12 = rf"""
WITH RECURSIVE c AS (
  SELECT coalesce('s' || conv_id, '') AS tag, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC.format(text="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations
), d AS (
  SELECT tag, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS again FROM c WHERE h <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), again) AS i FROM d
), t AS (
  SELECT *, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS final, row_number() OVER (PARTITION BY tag, role, text ORDER BY i) AS nth,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS kind, lag(CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END) OVER (PARTITION BY tag ORDER BY i) AS former FROM o
), r AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM t
), g AS (
  SELECT tag, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (former || kind NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY tag
), ins(z, letters, cost, upto, lines) AS (
  VALUES (0, '', 0, 0, []), (0, 'I', 2, 2, ['user:']), (0, 'II', 4, 3, ['user:', 'assistant:']), (1, '', 0, 1, []), (1, 'I', 2, 2, ['user:']), (1, 'II', 4, 3, ['user:', 'assistant:']),
    (2, '', 0, 2, []), (2, 'I', 2, 3, ['assistant:']), (2, 'II', 4, 2, ['assistant:', 'user:']), (3, '', 0, 3, []), (3, 'I', 2, 2, ['user:']), (3, 'II', 4, 3, ['user:', 'assistant:'])
), ed(letter, z, cost, upto, kind) AS (
  VALUES ('D', 0, 3, 0, ''), ('D', 1, 3, 1, ''), ('D', 2, 3, 2, ''), ('D', 3, 3, 3, ''), ('R', 0, 2, 2, ''), ('R', 1, 2, 2, ''), ('R', 2, 2, 3, ''), ('R', 3, 2, 2, ''),
    ('K', 0, 0, 1, 's'), ('K', 0, 0, 2, 'u'), ('K', 1, 0, 2, 'u'), ('K', 3, 0, 2, 'u'), ('K', 2, 0, 3, 'a')
), dp AS (
  SELECT tag, 0::BIGINT AS i, 0 AS z, {{'c': 0, 'a': ''}} AS b FROM g
  UNION ALL SELECT dp.tag, dp.i + 1, ed.upto, min({{'c': dp.b.c + ins.cost + ed.cost + CASE WHEN r.fault = 'truncated' AND ed.letter <> 'D' THEN 1 ELSE 0 END, 'a': dp.b.a || ins.letters || ed.letter}})
  FROM dp JOIN r ON r.tag = dp.tag AND r.i = dp.i + 1 JOIN ins ON ins.z = dp.z JOIN ed ON ed.z = ins.upto AND ed.kind IN ('', r.kind) AND (ed.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate')) GROUP BY dp.tag, dp.i, ed.upto
), best AS (
  SELECT g.*, min({{'c': dp.b.c + ins.cost, 'a': dp.b.a || ins.letters}}) AS b FROM g JOIN dp ON dp.tag = g.tag AND dp.i = g.n JOIN ins ON ins.z = dp.z AND ins.upto IN (0, 3) GROUP BY ALL
), e AS (
  SELECT tag, regexp_extract_all(b.a, 'I*[DKR]') AS each, regexp_extract(b.a, 'I*$') AS rest FROM best
), w AS (
  SELECT tag, 0::BIGINT AS i, 0 AS z, CAST([] AS VARCHAR[]) AS lines FROM e
  UNION ALL SELECT w.tag, w.i + 1, ed.upto, list_concat(w.lines, list_concat(ins.lines, CASE ed.letter WHEN 'K' THEN [r.role || ':' || r.text] WHEN 'R' THEN [CASE WHEN ed.z = 2 THEN 'assistant:' ELSE 'user:' END || r.text] ELSE [] END))
  FROM w JOIN e ON e.tag = w.tag JOIN r ON r.tag = w.tag AND r.i = w.i + 1 JOIN ins ON ins.z = w.z AND ins.letters || right(e.each[w.i + 1], 1) = e.each[w.i + 1] JOIN ed ON ed.letter = right(e.each[w.i + 1], 1) AND ed.z = ins.upto AND ed.kind IN ('', r.kind)
), done AS (
  SELECT best.*, sha256(coalesce(array_to_string(list_concat(w.lines, ins.lines), chr(10)), '')) AS text_hash FROM best JOIN e USING (tag) JOIN w ON w.tag = best.tag AND w.i = best.n JOIN ins ON ins.z = w.z AND ins.letters = e.rest
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, coalesce(text_hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT tag, conv_id FROM c) k LEFT JOIN done USING (tag)
"""

ORACLE = {"op6_mixing": OP6, "op9_url_filter": OP9, "op11_manifest": OP11, "op12_conversations": OP12}
