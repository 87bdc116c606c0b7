"""The same results in DuckDB's SQL, for the corpus queries that SQL can express."""

from .warc import named_characters, renumbered

OP1 = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
links AS (SELECT url AS u, unnest(list_concat(
  list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
  list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS l FROM pages WHERE html IS NOT NULL),
full_links AS (SELECT u, CASE WHEN regexp_matches(l, '(?i)^https?://') THEN l WHEN starts_with(l, '//') THEN split_part(u, '://', 1) || ':' || l WHEN starts_with(l, '/') THEN regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1) || l
  WHEN starts_with(l, '?') THEN regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') || l
  WHEN NOT regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:|^[?#]') THEN regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*/)', 1), ''), '/') || l END AS l
  FROM (SELECT u, replace(l, '&amp;', '&') AS l FROM links WHERE l <> '')),
names AS (SELECT DISTINCT x, CASE WHEN regexp_matches(regexp_extract(x, '(?s)^(.*?://[^/?#]*)', 1), '(?s)://.+') THEN translate(regexp_extract(x, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || coalesce(nullif(regexp_extract(x, '(?s)^.*?://[^/?#]*([^#]*)', 1), ''), '/') END AS node
  FROM (SELECT u AS x FROM full_links UNION SELECT l FROM full_links UNION SELECT url FROM pages)),
e AS (SELECT DISTINCT a.node AS s, b.node AS d FROM full_links f JOIN names a ON a.x = f.u JOIN names b ON b.x = f.l WHERE a.node <> b.node),
e2 AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
reach AS (SELECT s AS n, s AS m FROM e2 UNION SELECT reach.n, e2.d FROM reach JOIN e2 ON e2.s = reach.m),
comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n),
hp AS (SELECT n, c, regexp_extract(n, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(n, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM comp),
cv AS (SELECT c, bool_or(coalesce(v = 'allow', false)) AS a, bool_or(coalesce(v = 'block', false)) AS b FROM (SELECT n, c, (SELECT arg_max(v, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS v FROM hp) GROUP BY c),
r AS (SELECT page_id, url, host, path, (SELECT arg_max(struct_pack(r := rh || rp, v := v), length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS x FROM q)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, r.x.r AS rule, coalesce(r.x.v, CASE WHEN a THEN 'allow' WHEN b THEN 'block' ELSE 'allow' END) AS verdict, comp.c AS alias_of
FROM r LEFT JOIN names ON names.x = r.url LEFT JOIN comp ON comp.n = names.node LEFT JOIN cv ON cv.c = comp.c
"""

OP6 = r"""
WITH s0 AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last_turn, max_by(text, struct_pack(turn := turn, text := text)) AS reply FROM s0 WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id),
o AS (SELECT conv_id, last_turn, reply AS own, coalesce(lead(reply) OVER (ORDER BY conv_id), first_value(reply) OVER (ORDER BY conv_id)) AS reply FROM l),
s1 AS (SELECT conv_id, turn, role, CASE WHEN turn = last_turn AND role = 'assistant' THEN reply ELSE text END AS text FROM s0 JOIN o USING (conv_id) WHERE reply <> own AND (turn IS NULL OR turn <= last_turn)),
ta AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS x FROM s0 GROUP BY conv_id),
tb AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS x FROM s1 GROUP BY conv_id),
p AS (SELECT ta.conv_id AS chosen_id, tb.conv_id AS rejected_id, ta.x AS a, tb.x AS b FROM ta JOIN tb USING (conv_id)),
n AS (SELECT *, list_position(list_append(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i].role = b[i].role AND a[i].text = b[i].text, false)), false), false) - 1 AS k FROM p),
s AS (SELECT *, a[1 : k] AS pre, a[k + 1 :] AS c, b[k + 1 :] AS r FROM n),
m AS (SELECT *, list_transform(pre, lambda z: '<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) AS ps, list_transform(c, lambda z: '<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) AS cs, list_transform(r, lambda z: '<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) AS rs FROM s)
SELECT chosen_id, rejected_id, CAST(k AS INT) AS n_common, coalesce(array_to_string(ps, ''), '') AS prompt, coalesce(array_to_string(cs, ''), '') AS chosen, coalesce(array_to_string(rs, ''), '') AS rejected,
  coalesce(array_to_string(list_filter(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN c[i].role = 'assistant' THEN CAST(length(array_to_string(cs[1 : i], '')) - length(c[i].text) - 8 AS VARCHAR) || '-' || CAST(length(array_to_string(cs[1 : i], '')) AS VARCHAR) END), lambda z: z IS NOT NULL), ','), '') AS chosen_spans,
  coalesce(array_to_string(list_filter(list_transform(range(1, len(rs) + 1), lambda i: CASE WHEN r[i].role = 'assistant' THEN CAST(length(array_to_string(rs[1 : i], '')) - length(r[i].text) - 8 AS VARCHAR) || '-' || CAST(length(array_to_string(rs[1 : i], '')) AS VARCHAR) END), lambda z: z IS NOT NULL), ','), '') AS rejected_spans
FROM m
"""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
grams AS (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN base_failed OR 3 * (n_symbols + n_dup_lines) > n_words THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS total FROM h),
s AS (SELECT any_value(mean) AS mean, sum(n * pow(f / n - mean, 2)) FILTER (n > 1) AS spread, sum(1 - n / total) FILTER (n > 1) AS chance, sum((1 - n / total) * (n - 1)) FILTER (n > 1) AS slope FROM h, a),
r AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND slope > 0 THEN (spread / (mean * (1 - mean)) - chance) / slope END AS likeness FROM s),
p AS (SELECT mean, CASE WHEN likeness > 0 THEN least(greatest(1 / likeness - 1, 1), 1000) ELSE 1000 END AS k FROM r),
v AS (SELECT source, (f + mean * k) / (n + k) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT coalesce(rate >= 0.5, false)) AS kept, round(rate, 6) AS host_rate
FROM b LEFT JOIN v USING (source)
"""


OP3 = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT len(ws) AS l, greatest(len(ws) - 4, 1) AS n, item_id, ws FROM i WHERE len(ws) > 0),
im AS (SELECT DISTINCT l, array_to_string(ws[o : o + least(l, 5) - 1], ' ') AS g, least(l, 5) AS z FROM (SELECT l, ws, unnest(range(1, n + 1)) AS o FROM ig)),
dg AS (SELECT doc_id, ws, len(ws) AS n, p, z, array_to_string(ws[p : p + z - 1], ' ') AS g FROM (SELECT doc_id, ws, z, unnest(range(1, len(ws) - z + 2)) AS p FROM d, (SELECT DISTINCT z FROM im) WHERE len(ws) >= z)),
hit AS (SELECT DISTINCT doc_id, ws, n, l, z, p FROM dg JOIN im USING (z, g)),
w AS (SELECT DISTINCT doc_id, ws, l, unnest(range(greatest(least(p - (l - z + 1), n - l), 0), greatest(least(p - 1, n - l), 0) + 1)) AS s FROM hit),
x AS (SELECT row_number() OVER () AS wid, doc_id, l, ws[s + 1 : s + l] AS ws FROM w),
wg AS (SELECT wid, g, count(*) AS c FROM (SELECT wid, array_to_string(ws[o : o + least(len(ws), 5) - 1], ' ') AS g FROM (SELECT wid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS o FROM x)) GROUP BY ALL),
bg AS (SELECT item_id, l, g, count(*) AS c FROM (SELECT item_id, l, array_to_string(ws[o : o + least(l, 5) - 1], ' ') AS g FROM (SELECT item_id, l, ws, unnest(range(1, n + 1)) AS o FROM ig)) GROUP BY ALL),
wt AS (SELECT wid, sum(c) AS t FROM wg GROUP BY wid),
bt AS (SELECT item_id, sum(c) AS t FROM bg GROUP BY item_id),
common AS (SELECT wid, item_id, sum(least(wg.c, bg.c)) AS b FROM wg JOIN x USING (wid) JOIN bg ON bg.g = wg.g AND bg.l = x.l GROUP BY ALL)
SELECT doc_id, item_id, round(max(CAST(b AS DOUBLE) / CAST(wt.t + bt.t - b AS DOUBLE)), 6) AS similarity
FROM common JOIN wt USING (wid) JOIN bt USING (item_id) JOIN x USING (wid) WHERE 100 * b >= 80 * (wt.t + bt.t - b) GROUP BY doc_id, item_id
"""


def _base32(x: str) -> str:
    return f"'sha1:' || array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1({x}), CAST(g AS INT) * 5 + 1, 5) AS INT) >> b) % 32 AS INT) + 1, 1)), '')), '')"


def _uuid(x: str) -> str:
    return f"'<urn:uuid:' || substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12) || '>'"


_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', ' ', 'g'),
  '(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|main|aside|nav|header|footer|title|head|body|blockquote|pre|form)\b[^>]*>', chr(10), 'g'), '<[^<>]*>', '', 'g')"""
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"{_quoted(str(k))}: {_quoted(v)}" for k, v in table.items()) + "}"


def _entities(text: str) -> str:
    """Character references of a text, read once: the text is cut at each ampersand, and what each cut begins with looked up in ``names`` and ``numbers``."""
    bare = "rtrim(s.r, ';')"
    is_hex = "s.r[2] IN ('x', 'X')"
    digits = f"ltrim(CASE WHEN {is_hex} THEN {bare}[3:] ELSE {bare}[2:] END, '0')"
    number = f"CASE WHEN len({digits}) BETWEEN 1 AND 7 THEN CAST(CASE WHEN {is_hex} THEN '0x' ELSE '' END || {digits} AS BIGINT) END"
    char = f"coalesce(numbers[CAST({number} AS VARCHAR)], CASE WHEN {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr(CAST({number} AS INT)) ELSE chr(65533) END)"
    read = f"CASE WHEN s.r = '' THEN NULL WHEN s.r[1] = '#' THEN {char} ELSE names[{bare}] END"
    cuts = f"list_transform(string_split({text}, '&'), lambda x: {{'x': x, 'r': regexp_extract(x, '^(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;)', 1)}})"
    return f"array_to_string(list_transform({cuts}, lambda s, i: CASE WHEN i = 1 THEN s.x ELSE coalesce(({read}) || substr(s.x, len(s.r) + 1), '&' || s.x) END), '')"


_CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace({_entities("t")}, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""
_TITLE = rf"""trim(regexp_replace({_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g'))"""
_LANG = r"""lower(regexp_extract(html, '(?i)<html\b[^>]*\blang\s*=\s*["'']?([A-Za-z-]+)', 1))"""
_LINKS = r"len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref'))"
_NL = "chr(13) || chr(10)"
OP9 = f"""
WITH p AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS html FROM pages),
lookup AS (SELECT {_map(named_characters())} AS names, {_map(renumbered())} AS numbers),
t AS (SELECT *, 'Content-Type: text/html; charset=utf-8' || {_NL} || 'Content-Length: ' || CAST(octet_length(encode(html)) AS VARCHAR) AS source_headers, {_base32("html")} AS payload_digest, {_STRIPPED} AS t FROM p),
u AS (SELECT t.*, {_CLEAN} AS text, {_uuid("'response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(target_uri, '') || chr(10) || payload_digest")} AS refers_to, {_TITLE} AS title, {_LANG} AS lang, {_LINKS} AS links FROM t, lookup),
r AS (SELECT *, 'conversion' AS record_type, text AS block FROM u UNION ALL SELECT *, 'metadata' AS record_type, CASE WHEN title <> '' THEN 'title: ' || title || {_NL} ELSE '' END || CASE WHEN lang <> '' THEN 'language: ' || lang || {_NL} ELSE '' END
  || 'outlinks: ' || CAST(links AS VARCHAR) || {_NL} || 'text-length: ' || CAST(octet_length(encode(text)) AS VARCHAR) || {_NL} || 'http-header-' || replace(source_headers, chr(10), chr(10) || 'http-header-') || {_NL} AS block FROM u),
d AS (SELECT *, {_base32("block")} AS block_digest FROM r)
SELECT page_id, record_type, {_uuid("record_type || chr(10) || refers_to || chr(10) || block_digest")} AS record_id, refers_to, target_uri, source_headers, payload_digest, block_digest, CAST(octet_length(encode(block)) AS INT) AS content_length FROM d
"""


def _field(x: str) -> str:
    return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: CRC-32 bit by bit: a byte is taken in, then eight shifts follow, which are -1 in the list.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""

OP12 = f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS claim FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
low(g, k, i, n, h) AS (SELECT g, 0, i, n, leaf FROM p UNION ALL SELECT g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, k, i // 2, n),
sub AS (SELECT g, h AS subroot FROM low WHERE n = 1),
top(k, i, n, h) AS (SELECT 0, g, (SELECT count(*) FROM sub), subroot FROM sub UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 2, n),
beside AS (SELECT p.r, s.k, (p.i >> s.k) & 1 AS own, coalesce(b.h, '') AS h FROM p JOIN (SELECT DISTINCT g, k FROM low WHERE n > 1) s USING (g) LEFT JOIN low b ON b.g = p.g AND b.k = s.k AND b.i = xor(p.i >> s.k, 1)
  UNION ALL SELECT p.r, 1000 + s.k, (p.g >> s.k) & 1, coalesce(b.h, '') FROM p CROSS JOIN (SELECT DISTINCT k FROM top WHERE n > 1) s LEFT JOIN top b ON b.k = s.k AND b.i = xor(p.g >> s.k, 1)),
proof AS (SELECT r, string_agg(h, '' ORDER BY k) AS hs, list((CASE WHEN own = 1 THEN 'l' ELSE 'r' END) || h ORDER BY k) AS steps FROM beside GROUP BY r),
done AS (SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(hs, '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(claim, leaf)], coalesce(steps, [])), lambda a, s: sha256(CASE WHEN s[1] = 'l' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM p JOIN sub USING (g) LEFT JOIN proof USING (r))
SELECT *, folded_root = root AS verified FROM done
"""
