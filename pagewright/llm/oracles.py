"""DuckDB SQL for the queries that SQL can express."""

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n >= 2),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, range(3) AS k(k) GROUP BY rid),
m AS (SELECT doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
      coalesce(r.n, 0)::BIGINT AS n_repeat_words,
      length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters
      FROM w LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * letters < word_chars) AS kept
FROM m
"""

MIX_SOURCES = """
WITH w(source, weight) AS (VALUES ('src0', 0.2::DOUBLE), ('src1', 0.08), ('src2', 0.08), ('src3', 0.08), ('*', 0.56)),
d AS (SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source ELSE '*' END AS grp FROM documents),
c AS (SELECT grp, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM d GROUP BY grp),
r AS (SELECT grp, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM w) * (SELECT sum(chars) FROM c) / chars ELSE 0 END AS rate FROM c JOIN w ON grp = w.source),
t AS (SELECT grp, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY grp ORDER BY k) AS total
      FROM r, unnest(range(0, (rate + 12 * sqrt(rate) + 40)::BIGINT)) AS u(k) WHERE rate > 0),
a AS (SELECT grp, list(total ORDER BY k) AS steps FROM t GROUP BY grp),
n AS (SELECT d.*, len(list_filter(steps, lambda s: s <= ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS copies FROM d JOIN a USING (grp)),
e AS (SELECT * FROM n, unnest(range(0, copies)) AS u(copy))
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, ('0x' || substr(md5('18:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 15))::BIGINT AS position FROM e
"""

#: Host, path, rule and the rule's verdict; the model's verdicts are left null.
URL_RULES = r"""
WITH r(verdict, rule, host, path) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS own, rest FROM a),
p AS (SELECT row_number() OVER () AS rid, page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT rid, rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, rule) AS n
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN f ON p.rid = f.rid AND f.n = 1
"""

#: Counts every window of 200 bytes, as hexadecimal digits, under its md5.
SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT rid, list_transform(range(0, length(h) // 2 - 199), lambda i: md5_number(substr(h, 2 * i + 1, 400))) AS ks FROM d),
w AS (SELECT rid, unnest(ks) AS k, unnest(range(0, len(ks))) AS i FROM x),
m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
s AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS begins FROM m),
e AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (SELECT rid, i, sum(begins) OVER (PARTITION BY rid ORDER BY i) AS island FROM s) GROUP BY rid, island),
g AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM e),
k AS (SELECT rid, d.doc_id, any_value(h) AS h, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM g JOIN d USING (rid) GROUP BY rid, d.doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN d.h ELSE kept || substr(d.h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN k ON k.rid = d.rid
"""

#: Every pair that shares a shingle, by its exact similarity.
NGRAM_JACCARD = r"""
WITH RECURSIVE x AS (SELECT coalesce(text, '') AS t, count(*) AS copies, min(doc_id) AS least, row_number() OVER () AS i FROM documents GROUP BY 1),
w AS (SELECT i, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws FROM x),
s AS (SELECT DISTINCT i, array_to_string(ws[k : k + 4], ' ') AS g FROM w, unnest(range(1, CASE WHEN len(ws) >= 5 THEN len(ws) - 3 WHEN len(ws) > 0 THEN 2 ELSE 1 END)) AS u(k)),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
p AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.i < b.i GROUP BY a.i, b.i),
o AS (SELECT a, b FROM p JOIN n x ON x.i = p.a JOIN n y ON y.i = p.b WHERE 5 * c >= 4 * (x.n + y.n - c)),
l AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
c AS (SELECT i, i AS root FROM n UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.i),
m AS (SELECT c.i, min(x.least) AS group_id FROM c JOIN x ON x.i = c.root GROUP BY c.i),
k AS (SELECT l.a AS i, sum(x.copies) AS links FROM l JOIN x ON x.i = l.b GROUP BY l.a),
f AS (SELECT x.t, m.i IS NOT NULL AS worded, group_id, coalesce(links, 0) + copies - 1 AS links FROM x LEFT JOIN m USING (i) LEFT JOIN k USING (i))
SELECT doc_id, CASE WHEN worded THEN links ELSE 0 END::BIGINT AS n_links, CASE WHEN worded THEN group_id ELSE doc_id END AS group_id, (CASE WHEN worded THEN group_id ELSE doc_id END) IS NOT DISTINCT FROM doc_id AS kept
FROM documents JOIN f ON f.t = coalesce(text, '')
"""

#: Every pair of one label by its cosine.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT i, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.i AS a, b.i AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.i <> b.i WHERE list_dot_product(a.e, b.e) >= 0.98 * a.n * b.n),
c AS (SELECT i, i AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.i),
m AS (SELECT c.i, min(v.vec_id) AS component_id FROM c JOIN v ON v.i = c.root GROUP BY c.i),
k AS (SELECT a AS i, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m USING (i) LEFT JOIN k USING (i)
"""

#: Differences of shares in whole numbers (HUGEINT where counts are scaled).
SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
x AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL),
v AS (SELECT lang, term FROM x GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
t AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS terms, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM f),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (total + 5 * terms)::HUGEINT)::BIGINT AS p, (1 + (1000000000::HUGEINT * (lang_n + 5)::HUGEINT) // (lang_total + 5 * terms)::HUGEINT)::BIGINT AS q FROM t),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""

#: The crc32 bit by bit, costs to go by a recursion from the last turn, and the walk by one from the first.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE o AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT k, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(0, 8), lambda b: ((ascii(substr(k, i, 1)) >> b::INTEGER) & 1)::BIGINT)))),
      lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc FROM (SELECT DISTINCT k FROM o)),
d AS (SELECT o.*, xor(crc, 4294967295) % 20 AS draw FROM o JOIN z USING (k)),
e AS (SELECT g, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM d, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY g) AS n FROM e),
f AS (SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM n),
t AS (SELECT *, coalesce(fault, '') IN ('blank', 'duplicate') AS goes, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM f),
b AS (SELECT DISTINCT g, n AS i, 0::BIGINT AS c0, 6::BIGINT AS c1, 3::BIGINT AS c2, 0::BIGINT AS c3 FROM n
      UNION ALL SELECT g, i, least(b0, 3 + b2, 6 + b3), least(b1, 3 + b2, 6 + b3), least(b2, 3 + b3), least(b3, 3 + b2) FROM (
        SELECT b.g, b.i - 1 AS i,
          CASE WHEN goes THEN 4 + c0 ELSE least(4 + c0, 3 + more + c2, CASE r WHEN 's' THEN more + c1 WHEN 'u' THEN more + c2 END) END AS b0,
          CASE WHEN goes THEN 4 + c1 ELSE least(4 + c1, 3 + more + c2, CASE r WHEN 'u' THEN more + c2 END) END AS b1,
          CASE WHEN goes THEN 4 + c2 ELSE least(4 + c2, 3 + more + c3, CASE r WHEN 'a' THEN more + c3 END) END AS b2,
          CASE WHEN goes THEN 4 + c3 ELSE least(4 + c3, 3 + more + c2, CASE r WHEN 'u' THEN more + c2 END) END AS b3
        FROM b JOIN t ON t.g = b.g AND t.i = b.i)),
j AS (SELECT g, i, unnest([0, 1, 2, 3]) AS s, unnest([c0, c1, c2, c3]) AS c FROM b),
v AS (SELECT j.g, j.i, j.s, j.c, x.c AS behind, CASE WHEN j.s = 2 THEN j3.c3 ELSE j3.c2 END AS inserted, y.c0 AS y0, y.c1 AS y1, y.c2 AS y2, y.c3 AS y3, t.role, t.text, t.r, t.goes, t.more
      FROM j JOIN b j3 ON j3.g = j.g AND j3.i = j.i LEFT JOIN j x ON x.g = j.g AND x.i = j.i + 1 AND x.s = j.s LEFT JOIN b y ON y.g = j.g AND y.i = j.i + 1 LEFT JOIN t ON t.g = j.g AND t.i = j.i + 1),
a AS (SELECT *, CASE WHEN behind IS NOT NULL AND 4 + behind = c THEN 'D' WHEN 3 + inserted = c THEN 'I' WHEN behind IS NULL THEN NULL
      WHEN NOT goes AND more + CASE WHEN s = 0 AND r = 's' THEN y1 WHEN s <> 2 AND r = 'u' THEN y2 WHEN s = 2 AND r = 'a' THEN y3 END = c THEN 'K' ELSE 'R' END AS edit FROM v),
w AS (SELECT DISTINCT g, 0::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS lines FROM n
      UNION ALL SELECT w.g, w.i + CASE edit WHEN 'I' THEN 0 ELSE 1 END, CASE WHEN edit = 'D' THEN w.s WHEN edit = 'K' AND r = 's' THEN 1 WHEN w.s = 2 THEN 3 ELSE 2 END, audit || edit,
        CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END
      FROM w JOIN a ON a.g = w.g AND a.i = w.i AND a.s = w.s WHERE edit IS NOT NULL),
h AS (SELECT w.g, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM w JOIN a ON a.g = w.g AND a.i = w.i AND a.s = w.s WHERE edit IS NULL),
m AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(r) OVER (PARTITION BY g ORDER BY i) AS p FROM t) GROUP BY g),
q AS (SELECT DISTINCT g, conv_id FROM o)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(c0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM q LEFT JOIN m USING (g) LEFT JOIN h USING (g) LEFT JOIN b ON b.g = q.g AND b.i = 0
"""

#: Of pages with equal payloads, the one with the least page_id.
PACKAGED_PAGES = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
n AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS least, row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS nth FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN least END AS refers_to FROM n
"""
