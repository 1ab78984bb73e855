"""Interval joins by buckets of the address space, and filters on chunks derived from byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.lineage import cut


def buckets_of(ranges: DataFrame, key: str, lo: str, hi: str, per_bucket: int) -> DataFrame:
    """(key, base, top, width): cuts each key's address space so that a bucket holds about ``per_bucket`` ranges."""
    stats = ranges.groupBy(key).agg(F.min(lo).alias("base"), F.max(hi).alias("top"), F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / per_bucket)
    return stats.select(key, "base", "top", F.greatest(F.ceil((F.col("top") - F.col("base")) / parts), F.lit(1)).cast("bigint").alias("width"))


def bucketed(ranges: DataFrame, key: str, lo: str, hi: str, per_bucket: int) -> DataFrame:
    """Ranges cut at bucket borders: adds ``bucket`` and the part's ``lo`` and ``hi``; other columns stay."""
    joined = ranges.join(buckets_of(ranges, key, lo, hi, per_bucket), key)
    number = lambda x: f"CAST(({x} - base) DIV width AS BIGINT)"
    cut = joined.withColumn("bucket", F.explode(F.expr(f"sequence({number(lo)}, {number(f'{hi} - 1')})")))
    start = F.col("base") + F.col("bucket") * F.col("width")
    return cut.withColumn("lo", F.greatest(lo, start)).withColumn("hi", F.least(F.col(hi), start + F.col("width"))).drop("base", "top", "width")


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], per_bucket: int) -> DataFrame:
    """Inner join of half-open ranges that overlap: equal key and bucket, then the exact test; each pair once, in the
    bucket where the overlap starts. Buckets are those of the left side, and the right side is clipped to them. The left
    side is kept in the shared folder, as it is read for the buckets and for the join.
    """
    left = cut(left)
    grid = buckets_of(left, key, *left_range, per_bucket)

    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        df = df.join(grid, key).where((F.col(lo) < F.col("top")) & (F.col(hi) > F.col("base")))
        first, last = f"(greatest({lo}, base) - base) DIV width", f"(least({hi}, top) - 1 - base) DIV width"
        return df.withColumn("bucket", F.explode(F.expr(f"sequence(CAST({first} AS BIGINT), CAST({last} AS BIGINT))")))

    a = dealt(left, *left_range)
    b = dealt(right, *right_range).drop("base", "width", "top")
    both = a.join(b, [key, "bucket"]).where((F.col(left_range[0]) < F.col(right_range[1])) & (F.col(right_range[0]) < F.col(left_range[1])))
    home = F.expr(f"(greatest({left_range[0]}, {right_range[0]}) - base) DIV width")
    return both.where(F.col("bucket") == home).drop("bucket", "base", "width", "top")


def chunk_filter(offset: int, length: int, chunk_size: int) -> Column:
    """A filter on ``chunk_id`` for a byte range, which reaches the scan: the optimiser can't invert the division."""
    return F.col("chunk_id").between(offset // chunk_size, (offset + length - 1) // chunk_size)
