"""DuckDB twins of queries of this subpackage that are too long to stand beside them."""
from __future__ import annotations


def crc32(number: str) -> str:
    """The unsigned crc32 of a number's decimal text; DuckDB has none, so it goes bit by bit."""
    return f"""xor(list_reduce([CAST(4294967295 AS BIGINT)]
        || list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b)] || [CAST(0 AS BIGINT) FOR i IN range(8)],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, {_leaf('text')} AS leaf,
         CASE WHEN {crc32('doc_id')} % 3 = 0 THEN {_leaf(LOWER)} ELSE {_leaf('text')} END AS used
  FROM documents),
placed AS (
  SELECT doc_id, leaf, used, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
inside AS (
  SELECT grp, 0 AS level, pos, n, leaf AS hash FROM placed
  UNION ALL
  SELECT grp, any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY pos))
  FROM inside WHERE n > 1 GROUP BY grp, pos // 8),
subroots AS (SELECT grp, hash AS subroot FROM inside WHERE n = 1),
above AS (
  SELECT 0 AS level, grp AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS hash FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY pos))
  FROM above WHERE n > 1 GROUP BY pos // 8),
sibs AS (
  SELECT grp, level, pos, n, coalesce(string_agg(hash, '' ORDER BY pos) OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
         coalesce(string_agg(hash, '' ORDER BY pos) OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi
  FROM (SELECT grp, level, pos, n, hash FROM inside UNION ALL SELECT -1, level, pos, n, hash FROM above) WHERE n > 1),
climb AS (
  SELECT p.grp AS home, p.pos AS leaf_pos, p.grp AS grp, 0 AS level, p.pos AS pos, used AS fold, '' AS proof FROM placed p
  UNION ALL
  SELECT c.home, c.leaf_pos, CASE WHEN s.grp IS NULL THEN -1 ELSE c.grp END, CASE WHEN s.grp IS NULL THEN 0 ELSE c.level + 1 END,
         CASE WHEN s.grp IS NULL THEN c.home ELSE c.pos // 8 END,
         CASE WHEN s.grp IS NULL THEN c.fold ELSE sha256(s.lo || c.fold || s.hi) END, c.proof || coalesce(s.lo || s.hi, '')
  FROM climb c LEFT JOIN sibs s ON s.grp = c.grp AND s.level = c.level AND s.pos = c.pos
  WHERE s.grp IS NOT NULL OR c.grp >= 0),
done AS (SELECT c.* FROM climb c WHERE grp = -1 AND NOT EXISTS (SELECT 1 FROM sibs s WHERE s.grp = -1 AND s.level = c.level AND s.pos = c.pos)),
root AS (SELECT hash AS root FROM above WHERE n = 1)
SELECT p.doc_id, p.leaf, r.subroot, root.root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root, d.fold = root.root AS verified
FROM placed p JOIN subroots r USING (grp) JOIN done d ON d.home = p.grp AND d.leaf_pos = p.pos, root
"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS len, {crc32('c')} % 6 AS h, c - c % 100 AS base FROM turns GROUP BY c),
convs AS (SELECT o.*, least(o.h, coalesce(b.len, 0)) AS given FROM own o LEFT JOIN own b ON b.c = o.base),
made AS (
  SELECT k.c, t.pos AS depth, t.role, t.text FROM convs k JOIN turns t ON t.c = k.base AND t.pos <= k.h
  UNION ALL
  SELECT k.c, k.given + t.pos - k.h, t.role, t.text FROM convs k JOIN turns t ON t.c = k.c AND t.pos > k.h),
prefixes AS (
  SELECT c, depth, length(text) AS chars, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '')
         OVER (PARTITION BY c ORDER BY depth)) AS node FROM made
  UNION ALL SELECT c, 0, 0, '' FROM own),
linked AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY c) AS ends FROM prefixes),
nodes AS (
  SELECT node, any_value(parent) AS parent, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
         any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM linked GROUP BY node),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.parent = n.node) AS n_children FROM nodes n),
pairs AS (SELECT DISTINCT a.node AS above, b.node AS below FROM prefixes a JOIN prefixes b ON a.c = b.c AND a.depth <= b.depth),
sums AS (
  SELECT above AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM pairs JOIN counted ON counted.node = below GROUP BY above)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
