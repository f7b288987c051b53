"""DuckDB SQL of the queries that SQL can express; the tests hold the others against plain versions."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_FOLDED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low('text')}, {_SPACED}) AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' '))) AS s
  FROM w WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = d.doc_id"""

OP7 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_low('text')}, {_FOLDED}) AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda i: array_to_string(words[i:i + 9], ' '))) AS s,
         least(len(words), 10) AS k FROM items WHERE len(words) > 0),
w AS (SELECT doc_id, regexp_extract_all({_low('text')}, {_FOLDED}) AS words FROM documents),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, unnest(range(1, len(words) - k + 2)) AS i, words FROM w JOIN lengths ON len(words) >= k),
hits AS (
  SELECT d.doc_id, i, d.k, item FROM (SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS s FROM doc_windows) d
  JOIN item_windows v ON v.k = d.k AND v.s = d.s),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN words_hit h ON h.doc_id = w.doc_id LEFT JOIN items_hit t ON t.doc_id = w.doc_id"""

OP8 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
pieces AS (
  SELECT *, 24 + length(role) + length(regexp_replace(text, '([<\[]\\*)(/?s>|/?INST\]|\|[a-z_]{1,32}\|>)', '\1_\2', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id"""

OP10 = f"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7) AS BIGINT) AS hash FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM by_source),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS BIGINT) AS budget,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS share
  FROM weighed WINDOW before AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT budget AS level_budget, share AS level_share FROM filled WHERE budget * weight <= cap * share
  ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST LIMIT 1),
aims AS (
  SELECT source, source_size, CASE WHEN cap * level_share < level_budget * weight THEN CAST(cap AS DOUBLE)
         ELSE CAST(level_budget * weight AS DOUBLE) / CAST(level_share AS DOUBLE) END AS target FROM filled, level),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aims),
hashes AS (SELECT source, hash, CAST(sum(size) AS BIGINT) AS size FROM s GROUP BY ALL),
running AS (SELECT source, hash, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY hash) AS BIGINT) AS through FROM hashes),
edges AS (
  SELECT p.source, min(hash) AS edge, arg_min(through, hash) AS through, arg_min(size, hash) AS size,
         any_value(p.target - p.whole * p.source_size) AS budget
  FROM running r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source WHERE through > p.target - p.whole * p.source_size GROUP BY p.source),
cuts AS (SELECT source, CASE WHEN through - budget < budget - (through - size) THEN edge + 1 ELSE edge END AS threshold FROM edges)
SELECT s.doc_id, s.size, p.source_size, p.target,
       s.size * (p.whole + CASE WHEN s.hash < coalesce(c.threshold, 0) THEN 1 ELSE 0 END) AS taken
FROM s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source"""

OP12 = """
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS n_chars,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, list(g ORDER BY turn NULLS FIRST, g) AS gs, list(n_chars ORDER BY turn NULLS FIRST, g) AS ns,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM t GROUP BY conv_id),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.gs[1:o.h], []), o.gs[o.h + 1:]) AS gs, list_concat(coalesce(b.ns[1:o.h], []), o.ns[o.h + 1:]) AS ns
  FROM own o LEFT JOIN own b ON b.conv_id = o.base),
prefixes AS (SELECT conv_id, gs, ns, unnest(range(0, len(gs) + 1)) AS d FROM built),
nodes AS (
  SELECT array_to_string(gs[1:d], '/') || '/' AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(CASE WHEN d > 1 THEN array_to_string(gs[1:d - 1], '/') || '/' WHEN d = 1 THEN '/' END) AS above, coalesce(any_value(ns[d]), 0) AS n_chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len(gs)), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth),
kids AS (SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
counted AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM nodes v LEFT JOIN kids k ON k.above = v.node),
sums AS (
  SELECT v.node, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.n_chars) AS BIGINT) AS saved_tokens
  FROM counted v JOIN counted w ON v.depth = 0 OR starts_with(w.node, v.node) GROUP BY v.node)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM counted v JOIN sums s ON s.node = v.node LEFT JOIN counted p ON p.node = v.above"""

OP13 = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM e
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN least ON least.a = e.vec_id LEFT JOIN many ON many.a = e.vec_id"""

ORACLES = {"op6_jaccard": OP6, "op7_decontaminate": OP7, "op8_lines": OP8, "op9_chat": OP9, "op10_mixing": OP10,
           "op12_trie": OP12, "op13_embeddings": OP13}
