"""Running sums and predecessors over groups of any size: no window holds more than a task's share of rows.

Rows are dealt by range of (group, order) and kept; a window runs inside each part, and another over one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.lineage import cut


def dealt(df: DataFrame, by: str, *order: str) -> DataFrame:
    """``df`` with ``_part``: parts follow each other in order of (by, order), and are the same if a task runs again.

    The input is kept first, since the ranges are found by a look at it.
    """
    return cut(cut(df).repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))


def with_parts_before(df: DataFrame, by: str, total: Column, over) -> DataFrame:
    """``df`` of ``dealt`` with ``_before``: ``over`` (an aggregate function) of the parts' totals before a row's own, in its group."""
    parts = df.groupBy(by, "_part").agg(total.alias("_total"))
    before = over("_total").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return df.join(parts.select(by, "_part", before.alias("_before")), [by, "_part"])


def sums_before(df: DataFrame, by: str, value: str, name: str, *order: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, by ``order``, in the group ``by``."""
    rows = with_parts_before(dealt(df, by, *order), by, F.sum(value), F.sum)
    own = F.sum(value).over(Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.coalesce(own, F.lit(0))).cast("bigint")).drop("_part", "_before")


def largest_before(df: DataFrame, by: str, value: Column, name: str, *order: str) -> DataFrame:
    """Adds ``name``: the largest ``value`` of the rows before, by ``order``, in the group ``by``; null for the first."""
    rows = with_parts_before(dealt(df.withColumn("_value", value), by, *order), by, F.max("_value"), F.max)
    own = F.max("_value").over(Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.greatest("_before", own)).drop("_part", "_before", "_value")
