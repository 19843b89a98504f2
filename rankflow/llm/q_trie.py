"""Query and SQL of the conversation trie."""

from pyspark.sql import functions as F

from .registry import query
from .trie import digest_turns, splice, trie

# CRC-32 of the decimal digits, bit by bit; DuckDB has no function for it
_CRC = """xor(list_reduce([4294967295::BIGINT] || [ascii(ch)::BIGINT for ch in string_split(c::VARCHAR, '')],
  lambda s, b: list_reduce([xor(s, b), 1, 1, 1, 1, 1, 1, 1, 1],
    lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295::BIGINT)"""

SQL = f"""
WITH t AS (
  SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS m,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || ':' || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(m ORDER BY pos) AS ms FROM t GROUP BY c),
h AS (SELECT c, c - c % 5 AS base, ({_CRC} % 9)::BIGINT AS h, ms FROM l),
r AS (SELECT h.c, coalesce(b.ms[1:h.h], []) || h.ms[h.h + 1:] AS ms FROM h LEFT JOIN l b ON b.c = h.base),
p AS (SELECT c, ms, unnest(range(0, len(ms) + 1)) AS depth FROM r),
q AS (SELECT c, depth, ms[1:depth] AS prefix, depth = len(ms) AS ends FROM p),
n AS (SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
             strlen(coalesce(any_value(prefix[-1].t), '')) AS size
      FROM q GROUP BY depth, prefix),
e AS (SELECT q.c, q.depth, n.conv_id AS node FROM q JOIN n ON n.depth = q.depth AND n.prefix = q.prefix),
k AS (SELECT n.conv_id, n.depth, e.node AS parent FROM n LEFT JOIN e ON e.c = n.conv_id AND e.depth = n.depth - 1),
ch AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM k WHERE parent IS NOT NULL GROUP BY ALL),
f AS (SELECT n.*, k.parent, coalesce(ch.n_children, 0) AS n_children FROM n JOIN k USING (conv_id, depth)
      LEFT JOIN ch ON ch.parent = n.conv_id AND ch.depth = n.depth),
s AS (SELECT e.node, e.depth, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved
      FROM f JOIN e ON e.c = f.conv_id AND e.depth <= f.depth GROUP BY e.node, e.depth)
SELECT f.conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.node = f.conv_id AND s.depth = f.depth
"""

TURNS = 8       # most turns that a conversation takes from its base


@query("op12_conversation_trie", SQL)
def op12_conversation_trie(spark, sf_dir):
    digested = digest_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    share = F.crc32(F.col("conv").cast("string").cast("binary")) % (TURNS + 1)
    return trie(*splice(digested, share, F.col("conv") - F.col("conv") % 5, TURNS))
