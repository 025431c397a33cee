"""SQL for the training-data queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op2_sharding"] = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
l AS (SELECT doc_id, n_bytes, h, depth, h >> (60 - depth) AS p FROM d, (SELECT CAST(range AS BIGINT) AS depth FROM range(61))),
b AS (SELECT depth, p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM l GROUP BY depth, p HAVING sum(n_bytes) <= 1048576 OR min(h) = max(h)),
f AS (SELECT l.doc_id, l.n_bytes, l.depth, l.p, b.shard_bytes,
             row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS k FROM l JOIN b ON l.depth = b.depth AND l.p = b.p)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(depth AS INTEGER) AS depth, (CAST(1 AS BIGINT) << depth) + p AS shard_id, shard_bytes, shard_bytes > 1048576 AS oversized
FROM f WHERE k = 1
"""

ORACLE["op5_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(24 + 1 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) - 1)
           OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS len
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM p GROUP BY conv_id
"""

ORACLE["op7_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op10_url_filters"] = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT unnest([
  {'verdict': 'block', 'h': 'com', 'p': '/en/'}, {'verdict': 'allow', 'h': 'example.com', 'p': '/en/7'}, {'verdict': 'allow', 'h': 'net', 'p': '/de/'},
  {'verdict': 'block', 'h': 'example.net', 'p': '/de/8'}, {'verdict': 'block', 'h': 'org', 'p': '/es/'}]) AS x),
m AS (SELECT h.*, x.h || x.p AS rule, x.verdict AS verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(x.h || x.p) DESC NULLS LAST) AS k
      FROM h LEFT JOIN r ON (h.host = x.h OR h.host LIKE '%.' || x.h) AND starts_with(h.path, x.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

ORACLE["op4_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, i = x.n AND i = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id),
q AS (SELECT a AS doc_id, min(b) AS b FROM e WHERE same GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(q.b, d.doc_id)) AS rep_id, c.component_id, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id) JOIN c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY a) l USING (doc_id)
"""

ORACLE["op8_suffix_dedup"] = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM t)),
m AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE m.d < w.doc_id),
k AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS f FROM g)),
z AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
v AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f FROM (SELECT doc_id, a, b FROM z UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM t)),
o AS (SELECT v.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (v.a - f)), '' ORDER BY v.a, f) AS kept FROM v JOIN t ON t.doc_id = v.doc_id GROUP BY v.doc_id),
y AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n FROM z GROUP BY doc_id)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(y.n, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM t JOIN o USING (doc_id) LEFT JOIN y USING (doc_id)
"""

#: Every item of the driver's tables has five words or more.
ORACLE["op1_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
g AS (
  SELECT item_id, n, g, count(*) AS c
  FROM (SELECT item_id, len(w) AS n, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS k FROM i WHERE len(w) >= 5)) GROUP BY ALL),
h AS (
  SELECT doc_id, nw, p, g FROM (SELECT doc_id, len(w) AS nw, k - 1 AS p, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS k FROM d WHERE len(w) >= 5))
  WHERE g IN (SELECT g FROM g)),
s AS (
  SELECT doc_id, item_id, n, c, g, unnest(generate_series(greatest(0, p - (n - 5)), least(p, nw - n))) AS s FROM h JOIN g USING (g)),
m AS (
  SELECT doc_id, item_id, n, s, sum(x) AS shared FROM (SELECT doc_id, item_id, n, s, g, least(count(*), c) AS x FROM s GROUP BY doc_id, item_id, n, s, g, c) GROUP BY doc_id, item_id, n, s),
b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared DESC, s) AS k FROM m WHERE 100 * shared >= 80 * (2 * (n - 4) - shared))
SELECT doc_id, item_id, s AS first_word, n AS n_words, CAST(shared AS DOUBLE) / CAST(2 * (n - 4) - shared AS DOUBLE) AS similarity FROM b WHERE k = 1
"""

ORACLE["op11_merkle_manifest"] = """
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
f AS (
  SELECT *, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text, lowered], lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')) AS v FROM d),
l AS (
  SELECT doc_id, source, sha256(array_to_string(v[:5], '')) AS leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(array_to_string(v[:4], '') || v[6]) END AS tampered FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t AS (
  SELECT source, 0 AS h, i, leaf AS d FROM p
  UNION ALL SELECT source, h + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM t) WHERE c > 1 GROUP BY source, h, i // 16),
o AS (SELECT source, d AS subroot FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY h DESC) = 1),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM o),
u AS (
  SELECT 0 AS h, i, subroot AS d FROM s
  UNION ALL SELECT h + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY h, i // 16),
a AS (
  SELECT p.doc_id, p.source, t.h, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < p.i >> (4 * t.h)), '') AS before, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > p.i >> (4 * t.h)), '') AS after
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source AND t.i >> 4 = p.i >> (4 * t.h + 4) GROUP BY p.doc_id, p.source, t.h
  UNION ALL
  SELECT p.doc_id, p.source, 100 + u.h, coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i < s.i >> (4 * u.h)), ''), coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i > s.i >> (4 * u.h)), '')
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN u ON u.i >> 4 = s.i >> (4 * u.h + 4) GROUP BY p.doc_id, p.source, u.h),
top AS (SELECT source, max(h) AS h FROM t GROUP BY source),
q AS (
  SELECT a.*, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.h) AS k FROM a JOIN top ON a.source IS NOT DISTINCT FROM top.source
  WHERE a.h < top.h OR a.h >= 100 AND a.h < 100 + (SELECT max(h) FROM u)),
z AS (
  SELECT doc_id, 0 AS k, coalesce(tampered, leaf) AS d FROM p
  UNION ALL SELECT z.doc_id, z.k + 1, sha256(q.before || z.d || q.after) FROM z JOIN q ON q.doc_id = z.doc_id AND q.k = z.k + 1),
e AS (SELECT doc_id, d AS folded_root FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1),
g AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM q GROUP BY doc_id),
r AS (SELECT d AS root FROM u ORDER BY h DESC LIMIT 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, coalesce(g.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN e USING (doc_id) LEFT JOIN g USING (doc_id), r
"""

ORACLE["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(coalesce(c.n, 0) + 2 AS HUGEINT) * 1000000000 // CAST(coalesce(t.n, 0) + 2 * v.v AS HUGEINT) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + CAST(l.n + 2 AS HUGEINT) * 1000000000 // CAST(m.n + 2 * v.v AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) AS l JOIN (SELECT lang, sum(n) AS n FROM c GROUP BY lang) AS m USING (lang) JOIN v USING (lang)),
e AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(e.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""
