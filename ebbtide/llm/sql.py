"""Pieces of the DuckDB twins."""

#: unsigned crc32 of the decimal digits of an integer, bit by bit; {x} is the integer
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({x}::VARCHAR) + 1), lambda p: ascii(({x}::VARCHAR)[p])::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, d: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295::BIGINT)"""


def crc32(x: str) -> str:
    return CRC32.format(x=x)


def _written(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"


def _leaf(*fields: str) -> str:
    return f"sha256({' || '.join(_written(f) for f in fields)})"


MERKLE = f"""
    WITH RECURSIVE hashed AS (
        SELECT row_number() OVER () AS row_no, doc_id, lang, {_leaf('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
               {_leaf('doc_id', 'source', 'lang', f'(n_chars + CASE WHEN {crc32("doc_id")} % 7 = 0 THEN 1 ELSE 0 END)', 'text')} AS seen FROM documents),
    placed AS (
        SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS i FROM hashed),
    low(tree, level, i, hash, n) AS (
        SELECT tree, 0, i, leaf, n FROM placed
        UNION ALL
        SELECT tree, level + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, i // 2, n),
    high(level, i, hash, n) AS (
        SELECT 0, tree, hash, (SELECT count(DISTINCT tree) FROM placed) FROM low WHERE n = 1
        UNION ALL
        SELECT level + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, i // 2, n),
    node AS (SELECT tree, level, i, hash FROM low UNION ALL SELECT -1, level, i, hash FROM high),
    way(row_no, own, tree, level, i, n, fold, proof) AS (
        SELECT row_no, tree, tree, 0, i, n, seen, '' FROM placed
        UNION ALL
        SELECT row_no, own, CASE WHEN up THEN -1 ELSE w.tree END, CASE WHEN up THEN 0 ELSE w.level + 1 END, CASE WHEN up THEN own ELSE w.i // 2 END,
               CASE WHEN up THEN (SELECT max(n) FROM high) ELSE (w.n + 1) // 2 END,
               CASE WHEN up THEN fold WHEN s.hash IS NULL THEN sha256(fold) WHEN w.i % 2 = 0 THEN sha256(fold || s.hash) ELSE sha256(s.hash || fold) END,
               CASE WHEN up THEN proof ELSE proof || coalesce(s.hash, '') END
        FROM (SELECT *, n = 1 AND tree >= 0 AS up FROM way WHERE n > 1 OR tree >= 0) w
        LEFT JOIN node s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1) AND NOT up)
    SELECT p.doc_id, p.leaf, l.hash AS subroot, h.hash AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = h.hash AS verified
    FROM placed p JOIN low l ON l.tree = p.tree AND l.n = 1 JOIN way w ON w.row_no = p.row_no AND w.tree = -1 AND w.n = 1
    CROSS JOIN (SELECT hash FROM high WHERE n = 1) h"""


PREFIX_TRIE = f"""
    WITH own AS (
        SELECT conv_id, list({{'k': k, 'b': octet_length(encode(x))}} ORDER BY turn NULLS FIRST, k) AS turns
        FROM (SELECT conv_id, turn, coalesce(text, '') AS x, substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k
              FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
    headed AS (SELECT *, {crc32('conv_id')} % 9 AS h FROM own),
    rebuilt AS (
        SELECT c.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:h] END, c.turns[h + 1:]) AS turns
        FROM headed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
    membership AS (
        SELECT conv_id, d, len(turns) = d AS ended, turns[d].b AS bytes, sha256(coalesce(list_aggregate(list_transform(turns[1:d], lambda t: t.k), 'string_agg', ''), '')) AS node,
               CASE WHEN d > 0 THEN sha256(coalesce(list_aggregate(list_transform(turns[1:d - 1], lambda t: t.k), 'string_agg', ''), '')) END AS parent
        FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
    node AS (
        SELECT node, min(conv_id) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * coalesce(min(bytes), 0) AS saved,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM membership GROUP BY node),
    children AS (SELECT parent AS node, count(*) AS n_children FROM node GROUP BY parent),
    subtree AS (
        SELECT m.node, sum(u.saved) AS saved_tokens, sum(CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves
        FROM node u LEFT JOIN children c USING (node) JOIN membership m ON m.conv_id = u.conv_id AND m.d <= u.depth GROUP BY m.node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
           s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM node n JOIN subtree s USING (node) LEFT JOIN node p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node"""

NEAREST = """
    WITH v AS (
        SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))
          AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
    q AS (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
    d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - v.x[i]) * (q.x[i] - v.x[i])), lambda a, b: a + b)) AS score FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.x) = len(q.x))
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""
