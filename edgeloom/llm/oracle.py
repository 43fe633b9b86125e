"""The operators that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

#: CRC-32 by bits: a byte is mixed in, then shifted out eight times (-1 stands for a shift).
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({0}, '')])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


MERKLE = f"""
WITH RECURSIVE rows_of AS (
    SELECT doc_id, lang, {_leaf('text')} AS leaf, {_leaf('now')} AS claim
    FROM (SELECT *, CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 3 = 0
                         THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM documents)),
leaves AS (
    SELECT *, {_field('lang')} AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows_of),
inner_nodes AS (
    SELECT tree, 0 AS level, pos, leaf AS hash, n FROM leaves
    UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM inner_nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subroots AS (
    SELECT i.tree, i.level AS height, i.hash, row_number() OVER (ORDER BY l.lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
    FROM inner_nodes i JOIN (SELECT DISTINCT tree, lang FROM leaves) l USING (tree) WHERE i.n = 1),
outer_nodes AS (
    SELECT 0 AS level, pos, hash, n FROM subroots
    UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM outer_nodes WHERE n > 1 GROUP BY level, pos // 8, n),
siblings AS (
    SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM (SELECT tree, level, pos, n FROM inner_nodes UNION ALL SELECT '', level, pos, n FROM outer_nodes) a
    JOIN (SELECT tree, level, pos, hash FROM inner_nodes UNION ALL SELECT '', level, pos, hash FROM outer_nodes) b
      ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8
    WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
steps AS (
    SELECT l.doc_id, l.leaf, l.tree, l.pos AS place, s.level AS step, s.before, s.after FROM leaves l JOIN siblings s ON s.tree = l.tree AND s.pos = l.pos // (8 ** s.level)::BIGINT
    UNION ALL
    SELECT l.doc_id, l.leaf, l.tree, l.pos, r.height + s.level, s.before, s.after FROM leaves l JOIN subroots r USING (tree) JOIN siblings s ON s.tree = '' AND s.pos = r.pos // (8 ** s.level)::BIGINT),
folds AS (
    SELECT tree, pos AS place, 0 AS step, claim AS hash FROM leaves
    UNION ALL SELECT f.tree, f.place, f.step + 1, sha256(s.before || f.hash || s.after) FROM folds f JOIN steps s ON s.tree = f.tree AND s.place = f.place AND s.step = f.step),
last_folds AS (SELECT tree, place, arg_max(hash, step) AS hash FROM folds GROUP BY tree, place),
proofs AS (SELECT tree, place, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY tree, place)
SELECT l.doc_id, l.leaf, r.hash AS subroot, o.hash AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = o.hash AS verified
FROM leaves l JOIN subroots r USING (tree) JOIN outer_nodes o ON o.n = 1
JOIN last_folds f ON f.tree = l.tree AND f.place = l.pos LEFT JOIN proofs p ON p.tree = l.tree AND p.place = l.pos
"""

TRIE = f"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k, digest, words
    FROM (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
    SELECT c.conv_id, 0 AS side, o.k, o.digest, o.words FROM convs c JOIN own o ON o.conv_id = c.base AND o.k <= c.h
    UNION ALL SELECT c.conv_id, 1, o.k, o.digest, o.words FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
paths AS (
    SELECT c.conv_id, coalesce(string_agg(r.digest, '' ORDER BY r.side, r.k), '') AS path, list(r.words ORDER BY r.side, r.k) AS words, count(r.k) AS turns
    FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
members AS (SELECT conv_id, path, words, turns, unnest(range(0, turns + 1)) AS depth FROM paths),
nodes AS (
    SELECT left(path, 64 * depth) AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
    FROM members GROUP BY left(path, 64 * depth), depth),
kids AS (SELECT left(prefix, 64 * (depth - 1)) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (prefix)),
below AS (
    SELECT left(prefix, 64 * above) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved_tokens, c.ends_sha256
FROM counted c JOIN below b USING (prefix) LEFT JOIN nodes p ON c.depth > 0 AND p.prefix = left(c.prefix, 64 * (c.depth - 1))
"""

#: Exact join by prefixes: a set's rarest shingles, as many as a similar set cannot all lack.
MINHASH = """
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) END AS s FROM worded),
sets AS (SELECT s, row_number() OVER (ORDER BY min(doc_id)) AS set_id, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
items AS (SELECT set_id, n, unnest(s) AS x FROM sets),
ranked AS (SELECT set_id, n, x, row_number() OVER (PARTITION BY set_id ORDER BY df, x) AS k FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM items)),
prefixes AS (SELECT * FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),
pairs AS (
    SELECT DISTINCT a.set_id AS a, b.set_id AS b FROM prefixes a JOIN prefixes b ON a.x = b.x AND a.set_id < b.set_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
    SELECT a, b FROM (SELECT p.a, p.b, x.n AS n, y.n AS m, len(list_intersect(x.s, y.s)) AS common FROM pairs p JOIN sets x ON x.set_id = p.a JOIN sets y ON y.set_id = p.b)
    WHERE 100 * common >= 80 * (n + m - common)),
reached AS (
    SELECT set_id AS a, set_id AS b FROM sets
    UNION SELECT r.a, l.b FROM reached r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b),
roots AS (SELECT a AS set_id, min(b) AS root FROM reached GROUP BY a),
placed AS (SELECT d.doc_id, coalesce(len(d.s), 0) AS n_shingles, r.root FROM shingled d LEFT JOIN sets USING (s) LEFT JOIN roots r USING (set_id))
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM (SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id FROM placed)
"""
