"""DuckDB SQL for the numbered queries that SQL can express."""

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bi) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, bw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

#: crc32 of a list of byte values b, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP11 = rf"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, CAST({_CRC.format(bytes="list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))")} % 4 AS INTEGER) AS h FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h.h), []), list_slice(h.own, h.h + 1, len(h.own))) AS s FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth FROM r),
k AS (SELECT conv_id, n, depth, sha256(CAST(list_slice(s, 1, depth) AS VARCHAR) || len(list_slice(s, 1, depth)) || coalesce(list_aggregate(list_transform(list_slice(s, 1, depth), lambda x: length(x.r) || ',' || length(x.x)), 'string_agg', ';'), '')) AS k,
  CASE WHEN depth > 0 THEN len(regexp_extract_all(s[depth].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM p),
nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM k GROUP BY k, depth),
up AS (SELECT c.k, a.k AS parent FROM nodes c JOIN k a ON a.conv_id = c.conv_id AND a.depth = c.depth - 1),
kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
below AS (SELECT a.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((c.n - 1) * c.w) AS saved FROM nodes c JOIN k a ON a.conv_id = c.conv_id AND a.depth <= c.depth LEFT JOIN kids ON kids.k = c.k GROUP BY a.k)
SELECT nodes.conv_id, nodes.depth, pn.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below ON below.k = nodes.k LEFT JOIN kids ON kids.k = nodes.k LEFT JOIN up ON up.k = nodes.k LEFT JOIN nodes pn ON pn.k = up.parent
"""

#: The UTF-8 bytes of a string s of letters below U+0800.
_UTF8 = "flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN unicode(substr(s, i, 1)) < 128 THEN [unicode(substr(s, i, 1))::BIGINT] ELSE [192 + (unicode(substr(s, i, 1)) >> 6)::BIGINT, 128 + (unicode(substr(s, i, 1)) & 63)::BIGINT] END))"

OP13 = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
k AS (SELECT id || ':' || run AS s, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_CRC.format(bytes=_UTF8)} AS h FROM k),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.hole UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.hole),
b AS (SELECT near.word, count(*) AS n_near, max(v.n) AS most, first(other ORDER BY v.n DESC, other) AS best FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN best END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
up AS (SELECT word, word AS here FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.here AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f g ON g.word = up.here WHERE g.form IS NULL
"""
