"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP8 = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), per AS (
  SELECT source, sum(size) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight
  FROM per
), level AS (
  SELECT *, source_size * 3.0::DOUBLE AS stop, source_size * 3.0::DOUBLE / weight AS lvl FROM weighed
), rising AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE
             - coalesce(sum(stop) OVER (ORDER BY lvl, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY lvl, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rise
  FROM level
), goal AS (
  SELECT *, least(stop, weight * (SELECT rise FROM rising WHERE rise < lvl ORDER BY lvl LIMIT 1)) AS target FROM rising
), queued AS (
  SELECT s.*, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), packets AS (
  SELECT doc_id, k, size, p, CAST(cum + p * source_size AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1), (2)) AS t(p)
  WHERE size > 0 AND p * source_size < target
), served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, k, doc_id, p ROWS UNBOUNDED PRECEDING) AS total FROM packets
), taken AS (
  SELECT doc_id, sum(size) AS taken FROM served WHERE total <= (SELECT round(sum(target)) FROM goal) GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
"""

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = (
    """
WITH RECURSIVE w AS (
  SELECT doc_id, WORDS AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), n AS (
  SELECT doc_id, len(s) AS n FROM s
), e AS (
  SELECT doc_id, unnest(s) AS g FROM s
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 85 * (x.n + y.n - inter)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(reach.b) AS BIGINT) AS component_id
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""
).replace("WORDS", WORDS.replace("{text}", LOWER))

OP5 = (
    """
WITH w AS (
  SELECT doc_id, WORDS AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM w WHERE len(w) >= 20
), h AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s+19], ' ') ORDER BY doc_id, s) AS nth FROM win
), gone AS (
  SELECT DISTINCT doc_id, s + j AS i FROM h, range(0, 20) AS r(j) WHERE nth > 1
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w
), kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.i) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
).replace("WORDS", WORDS.replace("{text}", "coalesce(text, '')"))

OP11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
), n AS (
  SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s
)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3
"""

#: The crc32 of a decimal number, bit by bit.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))), lambda crc, byte:
  list_reduce(list_concat([xor(crc, byte)], range(8)), lambda c, n: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))"""

OP12 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base, CRC % 6 AS h FROM t GROUP BY conv_id
), plan AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base
), r AS (
  SELECT p.conv_id, t.pos - p.h + p.k AS pos, role, text FROM plan p JOIN t ON t.conv_id = p.conv_id AND t.pos > p.h
  UNION ALL SELECT p.conv_id, t.pos, role, text FROM plan p JOIN t ON t.conv_id = p.base AND t.pos <= p.k
), seq AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS s FROM r GROUP BY conv_id
  UNION ALL SELECT conv_id, [] FROM plan WHERE conv_id NOT IN (SELECT conv_id FROM r)
), m AS (
  SELECT conv_id, len(s) AS size, d AS depth, s[1:d] AS path, CASE WHEN d > 0 THEN length(s[d].text) ELSE 0 END AS chars FROM seq, unnest(range(0, len(s) + 1)) AS u(d)
), mem AS (
  SELECT conv_id, size, depth, chars, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM m
), node AS (
  SELECT node, depth, count(*) AS n_convs, max(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth) AS ends FROM mem GROUP BY node, depth
), edge AS (
  SELECT n.*, p.node AS parent FROM node n LEFT JOIN mem p ON p.conv_id = n.node AND p.depth = n.depth - 1
), child AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM edge WHERE parent IS NOT NULL GROUP BY 1, 2
), own AS (
  SELECT e.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM edge e LEFT JOIN child c ON c.node = e.node AND c.depth = e.depth
), sums AS (
  SELECT a.node, a.depth, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(o.saved) AS saved
  FROM own o JOIN mem a ON a.conv_id = o.node AND a.depth <= o.depth GROUP BY 1, 2
)
SELECT o.node AS conv_id, CAST(o.depth AS BIGINT) AS depth, o.parent AS parent_conv_id, CAST(o.n_convs AS BIGINT) AS n_convs, CAST(o.n_children AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
FROM own o JOIN sums s ON s.node = o.node AND s.depth = o.depth
""".replace("CRC", CRC)

ORACLES = {"op4_ngram_jaccard": OP4, "op5_substring_dedup": OP5, "op8_mixing": OP8, "op11_hard_negatives": OP11, "op12_prefix_trie": OP12}
