"""DuckDB SQL for op12, from all prefixes at once."""

_BIT = "lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
_BYTE = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {_BIT})"


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {_BYTE}), 4294967295::BIGINT)"


SQL = f"""
WITH turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
own AS (SELECT conv_id, t, conv_id - conv_id % 5 AS base, {crc32("conv_id::VARCHAR")} % 9 AS h FROM turns),
rebuilt AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.t, []), 1, o.h), list_slice(o.t, o.h + 1, len(o.t))) AS t
  FROM own o LEFT JOIN turns b ON b.conv_id = o.base),
prefixes AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt),
keyed AS (SELECT conv_id, depth, md5(list_slice(t, 1, depth)::VARCHAR) AS key, CASE WHEN depth > 0 THEN md5(list_slice(t, 1, depth - 1)::VARCHAR) END AS up,
                 CASE WHEN depth > 0 THEN strlen(t[depth].text) ELSE 0 END AS size, depth = len(t) AS ends FROM prefixes),
nodes AS (
  SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM keyed GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.key = n.key),
-- the member with the smallest id stands for a node's path
above AS (SELECT a.depth, a.key, n.saved, n.n_children FROM full_nodes n JOIN keyed r ON r.conv_id = n.conv_id AND r.depth <= n.depth
          JOIN nodes a ON a.depth = r.depth AND a.key = r.key),
sums AS (SELECT depth, key, sum(saved) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves FROM above GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.depth = n.depth AND s.key = n.key LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.up
"""
