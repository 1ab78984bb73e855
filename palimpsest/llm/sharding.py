"""Sharding by longest processing time: groups of equal texts, largest first, go to the least-loaded shard.

Groups are counted by size, in exact bytes. The heap runs on the driver over the distinct sizes, whatever the number of
groups: a million sizes up to 1 MiB at most, and no more than there are MiB of input beyond. Items of one size meet the
shards in cycles, and a cycle is planned at once. Groups take their shards from the plan by their rank within their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.textops import shared_checkpoints

def plan(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, list[int]]]:
    """From (class, size, count), largest size first: runs of (class, first rank, length, shards in turn).

    It is the schedule of a heap ordered by (load, shard). Of items of one size, the shards whose loads lie within
    one item of the least take turns, until the last of them would pass the next shard.
    """
    load, out = [0] * shards, []
    for kind, size, count in sizes:
        rank = 0
        while count:
            order = sorted(range(shards), key=lambda i: (load[i], i))
            band = [i for i in order if load[i] < load[order[0]] + size]
            rest = order[len(band) :]
            n = count if not rest else min(count, ((load[rest[0]] - 1 - load[band[-1]]) // size + 1) * len(band))
            out.append((kind, rank, n, band))
            for k, i in enumerate(band):
                load[i] += size * (n // len(band) + (k < n % len(band)))
            rank, count = rank + n, count - n
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null) of each row.

    Law ``bytes``: the shards' sums of sizes are as near equal as LPT gets them. A null text counts as empty. Equal
    texts share a shard. Groups of one size go by their SHA-256. Slots follow (doc_id, SHA-256), null doc_ids first;
    repeated rows have slots of their own in any order. An empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key")).checkpoint()
    groups = rows.groupBy("key").agg(F.sum("size").alias("kind")).withColumn("salt", F.substring("key", 1, 2)).checkpoint()
    counted = groups.groupBy("kind", "salt").agg(F.count("*").alias("n"))
    sizes = [(r.kind, r.kind, r.n) for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("kind")).collect()]
    runs = spark.createDataFrame(plan(sizes, shards), "kind bigint, start bigint, length bigint, turn array<int>")
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ranked = groups.withColumn("r", F.row_number().over(Window.partitionBy("kind", "salt").orderBy("key"))).join(counted.select("kind", "salt", F.coalesce(before, F.lit(0)).alias("before")), ["kind", "salt"])
    rank = F.col("before") + F.col("r") - 1
    placed = ranked.withColumn("rank", rank).join(runs, "kind").where("rank >= start AND rank < start + length").select("key", F.expr("get(turn, CAST((rank - start) % size(turn) AS INT))").alias("shard"))
    return with_slots(rows.join(placed, "key")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds gapless ``slot`` numbers within ``shard``, in order of (doc_id, key).

    Rows are dealt by range, so that every part is as large as a task's share whatever the identifiers are; parts are
    numbered apart and moved by the parts before. The dealt rows are kept, as parts must not change if a task runs again.
    """
    dealt = rows.repartitionByRange("shard", "doc_id", "key").withColumn("part", F.spark_partition_id()).checkpoint()
    counted = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key"))
    return dealt.withColumn("own", own).join(counted.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before")), ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("own") - 1).cast("long"))
