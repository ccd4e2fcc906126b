"""SQL for the queries that SQL can express, for DuckDB over views of the tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"

SHARDING = """
WITH RECURSIVE t(i, k, c) AS (SELECT i, 0, i FROM range(0, 256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) + 1 AS size FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, size - 1), lambda i: CAST((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h, tab),
s AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total FROM crc),
p AS (SELECT *, CAST(least(15, (2 * (upto - size) + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

DECONTAMINATION = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""

#: All pairs that share a shingle, where the operator takes those that share a band.
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT min(doc_id) AS rep, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
every AS (SELECT doc_id, {_WORDS} AS w FROM documents),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM every) GROUP BY word),
idf AS (SELECT word, 1 + ln((1 + (SELECT count(*) FROM documents)) / (1.0 + n)) AS v FROM df),
t AS (SELECT rep, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
tv AS (SELECT rep, n, i, word, v FROM t JOIN idf USING (word)),
g AS (SELECT rep, n, i, string_agg(word, ' ') OVER x AS s, avg(v) OVER x AS v FROM tv WINDOW x AS (PARTITION BY rep ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sh AS (SELECT rep, s, sum(v) AS v FROM g WHERE i <= greatest(n - 4, 1) GROUP BY rep, s),
size AS (SELECT rep, sum(v) AS v FROM sh GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.v, b.v)) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN size x ON x.rep = a JOIN size y ON y.rep = b WHERE m >= 0.8 * (x.v + y.v - m) - 1e-9),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, root) AS (SELECT rep, rep FROM d UNION SELECT e.b, c.root FROM c JOIN e ON c.id = e.a),
m AS (SELECT id, min(root) AS class_id FROM c GROUP BY id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, doc_id = coalesce(class_id, doc_id) AS kept FROM documents LEFT JOIN d ON d.text = documents.text LEFT JOIN m ON m.id = d.rep
"""

EMBEDDING_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON c.id = l.a),
m AS (SELECT id, min(root) AS component_id FROM c GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON vec_id = id LEFT JOIN n ON vec_id = a
"""

RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
q AS (SELECT DISTINCT item_id, unnest(w) AS term FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
v AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g),
m AS (SELECT doc_id, 10 + (90 * len(w) * nn) // ll AS m FROM d, g),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN v USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

COLLOCATIONS = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
o AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM o GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT *, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
l AS (SELECT cut.*, f.a AS l FROM cut JOIN f ON f.lang = cut.lang AND f.phrase = cut.first),
cuts AS (SELECT l.*, f.a AS r, CAST(1000000::HUGEINT * l.a * l.a // (l.l::HUGEINT * f.a) AS BIGINT) AS score FROM l JOIN f ON f.lang = l.lang AND f.phrase = l.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score FROM best b JOIN n ON n.lang = b.lang LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.k = 2
WHERE g.a IS NULL OR 100 * g.a < 50 * b.a QUALIFY rank <= 2000
"""
