"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import remove, shared_folder, written


def keyed(df: DataFrame, column: str) -> DataFrame:
    """Adds a join key that no grouping by ``column`` has dealt yet: both sides of the join are then shuffled for it
    alone, and adaptive execution can split a hot node's rows, as it can't below an aggregation."""
    return df.withColumn("k", F.bitwise_not(column))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of an edge other than the root itself.

    Loops, repeated edges and either direction of an edge are allowed. Each round is a table in the shared folder, so
    that a lost executor costs no earlier round; the table before it is deleted. Rounds grow with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    top = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    state = lambda df: df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), f"{top}/0")
    mark, n = state(now), 0
    while mark[0]:
        both = now.union(now.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = keyed(both, "u").join(keyed(least, "u").drop("u"), "k").where("v > u AND v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = keyed(large, "hi").join(keyed(down, "hi").drop("hi"), "k")
        small = pairs.select("hi", F.col("m").alias("lo")).union(pairs.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        n += 1
        now = written(small, f"{top}/{n}")
        remove(spark, f"{top}/{n - 1}")
        before, mark = mark, state(now)
        if before == mark:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
