"""Registered queries of the training-data operators, with production parameters and whole tables.

``QUERIES``: name to function of (spark, sf_dir). ``ORACLES``: DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import byte_bpe, decontamination, gif_media, jaccard_join, langid, quality, sharding, tool_calls, toxicity, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(table(spark, sf_dir, "documents"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.digests(table(spark, sf_dir, "documents"))


@query
def op1_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


ORACLES["op1_jaccard_forest"] = r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
  FROM words),
nodes AS (SELECT g, min(doc_id) AS rep, count(*) AS weight, len(g) AS n FROM sets WHERE len(g) > 0 GROUP BY g),
shingles AS (SELECT rep, n, weight, unnest(g) AS s FROM nodes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, a.weight AS wa, b.weight AS wb
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.rep < b.rep
  GROUP BY a.rep, a.n, a.weight, b.rep, b.n, b.weight
  HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
links AS (SELECT a, b, wb AS w FROM pairs UNION ALL SELECT b, a, wa FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS rep, count(*) AS texts, sum(w) AS docs FROM links GROUP BY a)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id,
  CAST(coalesce(k.docs, 0) + coalesce(n.weight, 1) - 1 AS BIGINT) AS n_links,
  CAST(coalesce(k.texts, 0) AS BIGINT) AS n_text_links
FROM sets s LEFT JOIN nodes n ON s.g = n.g LEFT JOIN classes c ON n.rep = c.rep LEFT JOIN counts k ON n.rep = k.rep
"""


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


ORACLES["op2_warc_revisits"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest
"""


@query
def op4_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


ORACLES["op4_lpt_shards"] = """
WITH RECURSIVE
polynomial AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, CAST(len(h) // 2 + 1 AS BIGINT) AS size, sha256(text) AS key,
  xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda p: CAST('0x' || p AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM d, polynomial),
g AS (SELECT key, sum(size) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, key) AS rn FROM sized GROUP BY key),
heap AS (
  SELECT CAST(0 AS BIGINT) AS rn, list_transform(range(16), lambda i: CAST(0 AS HUGEINT)) AS loads, 0 AS shard
  UNION ALL
  SELECT g.rn, list_transform(loads, lambda x, i: x + CASE WHEN i = p THEN bytes ELSE 0 END), p - 1
  FROM (SELECT rn, loads, list_position(loads, list_min(loads)) AS p FROM heap) h JOIN g ON g.rn = h.rn + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, key) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM sized JOIN g USING (key) JOIN heap USING (rn)
"""


@query
def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op8_spaced_seeds"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS b FROM benchmark),
dt AS (SELECT doc_id, len(t) AS td, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM d),
bt AS (SELECT item_id, len(b) AS tb, unnest(b) AS w, unnest(range(1, len(b) + 1)) AS p FROM b),
same AS (SELECT DISTINCT doc_id, item_id, td, tb, least(tb, 16) AS n, i - p AS diagonal, p FROM dt JOIN bt USING (w)),
runs AS (
  SELECT *, greatest(1, 1 - diagonal) AS first, least(tb, td - diagonal) - n + 1 AS last,
    count(*) OVER (PARTITION BY doc_id, item_id, td, tb, diagonal ORDER BY p RANGE BETWEEN 15 PRECEDING AND CURRENT ROW) AS upto,
    count(*) FILTER (p < greatest(1, 1 - diagonal) + n) OVER (PARTITION BY doc_id, item_id, td, tb, diagonal) AS early
  FROM same),
c AS (
  SELECT doc_id, item_id, n, diagonal + greatest(p - n + 1, first) - 1 AS start, CASE WHEN p - n + 1 >= first THEN upto ELSE early END AS matches
  FROM runs WHERE greatest(p - n + 1, first) <= last),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matches DESC, start, n DESC) AS rn FROM c WHERE matches >= ceil(n * 0.8))
SELECT doc_id, item_id, CAST(matches AS INT) AS matches, CAST(n AS INT) AS "window", CAST(start AS INT) AS start FROM r WHERE rn = 1
"""


@query
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.of_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.SCHEMAS)


ORACLES["op6_tool_calls"] = """
WITH c AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE WHEN turn < 2 THEN 'ask' ELSE 'follow_up' END AS name, text,
    CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS after,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, count(*) AS n, min(turn) AS result_turn, arg_min(text, turn) AS content
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, turn, coalesce(c.call_id, r.call_id) AS call_id,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  name, CAST(position AS BIGINT) AS position, CAST(coalesce(n, 0) AS BIGINT) AS n_results, result_turn,
  CASE WHEN c.call_id IS NULL THEN NULL WHEN text IS NULL THEN 'text: missing' WHEN length(text) < 40 THEN 'text: too short'
    WHEN name = 'follow_up' AND length(text) > 2000 THEN 'text: too long' ELSE '' END AS errors,
  '{' || CASE WHEN c.call_id IS NULL THEN '' ELSE '"arguments":{' || CASE WHEN after IS NULL THEN '' ELSE '"after":' || to_json(after) || ',' END
      || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) || ',' END || '"turn":' || turn || '},' END
    || '"id":' || to_json(coalesce(c.call_id, r.call_id))
    || CASE WHEN name IS NULL THEN '' ELSE ',"name":' || to_json(name) END
    || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END || '}' AS exchange
FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""
