"""Groupings whose tasks hold a partition's share of the rows, however many a task makes of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by a hash of the keys, before a grouping by them whose aggregates are of text.

    Such a grouping sorts its rows before it combines them, and a small file may become many rows in one task. Dealt
    rows are sorted a partition at a time, and adaptive execution brings partitions near its advisory size. It may split
    those of hot keys where several tasks wrote them, as the grouping combines before a shuffle of its own.
    """
    return df.withColumn("_dealt", F.xxhash64(*keys)).hint("rebalance", "_dealt").drop("_dealt")
