"""Interval algebra of address maps: overlay, coalescing, gaps, look-up, compaction.

A map is a set of ranges (map_urn, map_offset, length, target_offset, target, seq). A map may hold very many writes:
its address space is cut into buckets of about BUCKET_RANGES writes, so that no join or window needs a whole map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.range_join import bucketed, overlap_join
from palimpsest.plans.running import dealt, largest_before, sums_before
from palimpsest.vocabulary import UNREADABLE

BUCKET_RANGES = 256
OUT = ["map_urn", "map_offset", "length", "target_offset", "target"]


def overlay(ranges: DataFrame) -> DataFrame:
    """The map after all writes in order of seq: the newest covers the older ones, and neighbours that continue each
    other in map and target are one range. Writes of no or negative length are not writes. Of equal seq in a map, the
    larger (target, target_offset) counts as newer.
    """
    writes = ranges.where("length > 0").select("map_urn", "map_offset", (F.col("map_offset") + F.col("length")).alias("stop"), "target_offset", "target", "seq")
    pieces = bucketed(writes, "map_urn", "map_offset", "stop", BUCKET_RANGES)
    ends = pieces.select("map_urn", "bucket", F.explode(F.array("lo", "hi")).alias("x")).distinct()
    steps = ends.withColumn("y", F.lead("x").over(Window.partitionBy("map_urn", "bucket").orderBy("x"))).where("y IS NOT NULL")
    covered = pieces.join(steps, ["map_urn", "bucket"]).where("lo <= x AND y <= hi")
    newest = F.max(F.struct("seq", "target", (F.col("target_offset") + F.col("x") - F.col("map_offset")).alias("target_offset")))
    top = covered.groupBy("map_urn", "bucket", "x", "y").agg(newest.alias("w"))
    flat = top.select("map_urn", "bucket", F.col("x").alias("map_offset"), (F.col("y") - F.col("x")).alias("length"), "w.target_offset", "w.target")
    return coalesce_buckets(flat).select(OUT)


def islands(df: DataFrame, by: list[str]) -> DataFrame:
    """Merges neighbours within ``by``, in order of map_offset: adjacent in the map and in the same target."""
    w = Window.partitionBy(by).orderBy("map_offset")
    end, target_end = F.col("map_offset") + F.col("length"), F.col("target_offset") + F.col("length")
    goes_on = (F.lag(end).over(w) == F.col("map_offset")) & F.lag("target").over(w).eqNullSafe(F.col("target")) & (F.lag(target_end).over(w) == F.col("target_offset"))
    broken = df.withColumn("fresh", F.when(goes_on, 0).otherwise(1))
    numbered = broken.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(*by, "island").agg(F.min("map_offset").alias("map_offset"), F.sum("length").alias("length"), F.min("target_offset").alias("target_offset"), F.first("target").alias("target"))
    return grouped


def coalesce(ranges: DataFrame) -> DataFrame:
    """Merged ranges of maps without overlap (the second half of ``overlay``)."""
    parts = dealt(ranges.select(OUT), "map_urn", "map_offset").withColumnRenamed("_part", "bucket")
    return coalesce_buckets(parts).select(OUT)


def coalesce_buckets(flat: DataFrame) -> DataFrame:
    """Islands within buckets first; then, over one row a bucket, which buckets' first islands continue the bucket before."""
    own = islands(flat, ["map_urn", "bucket"])
    edge = lambda f, name: f(F.struct("island", "map_offset", "length", "target_offset", "target")).alias(name)
    buckets = own.groupBy("map_urn", "bucket").agg(edge(F.min, "head"), edge(F.max, "tail"))
    w = Window.partitionBy("map_urn").orderBy("bucket")
    before = F.lag("tail").over(w)
    goes_on = (before["map_offset"] + before["length"] == F.col("head.map_offset")) & before["target"].eqNullSafe(F.col("head.target")) & (before["target_offset"] + before["length"] == F.col("head.target_offset"))
    buckets = buckets.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    opens = F.when(~(F.col("goes_on") & (F.col("tail.island") == F.col("head.island"))), F.col("tail.map_offset"))
    start = F.last(opens, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    chains = buckets.withColumn("start", F.when(F.col("goes_on"), start)).where("start IS NOT NULL").select("map_urn", "bucket", F.col("head.island").alias("island"), "start")
    joined = own.join(chains, ["map_urn", "bucket", "island"], "left").withColumn("start", F.coalesce("start", "map_offset"))
    return joined.groupBy("map_urn", "start").agg(F.min("map_offset").alias("map_offset"), F.sum("length").alias("length"), F.min("target_offset").alias("target_offset"), F.first("target").alias("target"))


def clear(ranges: DataFrame) -> DataFrame:
    """The map without ranges; its size attribute, which is a triple, stays."""
    return ranges.where(F.lit(False))


def get_ranges(ranges: DataFrame) -> DataFrame:
    return ranges.select(OUT).orderBy("map_urn", "map_offset")


def size(ranges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(map_urn, size): the ``size`` attribute where given, else the largest end ever written."""
    ends = ranges.where("length > 0").groupBy("map_urn").agg(F.max(F.col("map_offset") + F.col("length")).alias("end"))
    if sizes is None:
        return ends.withColumnRenamed("end", "size")
    return ends.join(sizes.select("map_urn", "size"), "map_urn", "full").select("map_urn", F.coalesce("size", "end").alias("size"))


def with_gaps(ranges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The ranges and the gaps between them and up to the size, as rows with a null target: they read as NUL bytes."""
    total = size(ranges) if sizes is None else sizes
    marker = total.select("map_urn", F.col("size").alias("map_offset"), F.lit(0).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("target_offset"), F.lit(None).cast("string").alias("target"))
    rows = ranges.select(OUT).unionByName(marker)
    rows = largest_before(rows, "map_urn", F.col("map_offset") + F.col("length"), "end", "map_offset", "length").withColumn("end", F.coalesce("end", F.lit(0)))
    gaps = rows.where("map_offset > end").select("map_urn", F.col("end").alias("map_offset"), (F.col("map_offset") - F.col("end")).alias("length"), F.lit(0).cast("bigint").alias("target_offset"), F.lit(None).cast("string").alias("target"))
    return rows.where("length > 0").select(OUT).unionByName(gaps)


def lookup(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """Parts of ranges (without overlap) that requests (request_id, map_urn, offset, length) read.

    Adds request_id, ``out_offset`` in the request, and the part's length and target_offset. Large maps are joined by buckets.
    """
    wanted = requests.where("length > 0").select("map_urn", "request_id", F.col("offset").alias("r_lo"), (F.col("offset") + F.col("length")).alias("r_hi"))
    left = ranges.where("length > 0").select(*OUT, (F.col("map_offset") + F.col("length")).alias("stop"))
    joined = overlap_join(left, wanted, "map_urn", ("map_offset", "stop"), ("r_lo", "r_hi"), BUCKET_RANGES)
    lo, hi = F.greatest("map_offset", "r_lo"), F.least("stop", "r_hi")
    return joined.select("request_id", "map_urn", (lo - F.col("r_lo")).alias("out_offset"), (hi - lo).alias("length"), (F.col("target_offset") + lo - F.col("map_offset")).alias("target_offset"), "target")


def compact(ranges: DataFrame) -> DataFrame:
    """Adds ``dense_offset``: where each range lies when the data are copied in map order without gaps."""
    return sums_before(ranges, "map_urn", "length", "dense_offset", "map_offset")


def appended(writes: DataFrame) -> DataFrame:
    """Writes (map_urn, seq, map_offset, length) go to the end of a data stream: adds ``target_offset``."""
    return sums_before(writes, "map_urn", "length", "target_offset", "seq")


def whole_stream(streams: DataFrame) -> DataFrame:
    """One range (0, 0, size) for each (map_urn, target, size)."""
    zero = F.lit(0).cast("bigint")
    return streams.select("map_urn", zero.alias("map_offset"), F.col("size").alias("length"), zero.alias("target_offset"), "target")


def number_targets(ranges: DataFrame) -> DataFrame:
    """(map_urn, target, target_id): targets by their first write, from 0."""
    first = ranges.groupBy("map_urn", "target").agg(F.min("seq").alias("first"))
    return first.select("map_urn", "target", (F.row_number().over(Window.partitionBy("map_urn").orderBy("first", "target")) - 1).alias("target_id"))


def mark_unreadable(ranges: DataFrame, failed) -> DataFrame:
    """Writes for which ``failed`` holds map to the unreadable pattern, at their own offset, so that neighbours merge."""
    bad = F.expr(failed) if isinstance(failed, str) else failed
    return ranges.withColumn("target_offset", F.when(bad, F.col("map_offset")).otherwise(F.col("target_offset"))).withColumn("target", F.when(bad, UNREADABLE).otherwise(F.col("target")))


def elf_layout(ranges: DataFrame, header: int = 64, entry: int = 56) -> DataFrame:
    """Program headers of a core file: one loadable segment a range, whose bodies follow the headers in map order."""
    dense = compact(ranges)
    total = dense.groupBy("map_urn").agg(F.count("*").alias("n"))
    body = F.lit(header) + F.lit(entry) * F.col("n")
    return dense.join(total, "map_urn").select("map_urn", F.col("map_offset").alias("vaddr"), F.col("length").alias("memsz"), (body + F.col("dense_offset")).cast("bigint").alias("file_offset"))


def pair_kcore(segments: DataFrame, ram: DataFrame) -> DataFrame:
    """Memory segments (dump, vaddr, paddr, memsz, filesz, off) and RAM ranges (dump, start) in order of address.

    The k-th segment taken gets the k-th RAM range; a segment with a physical address other than the start awaited is
    passed over. The cursor moves only when a segment is taken, so each dump, of a few segments, is one ordered fold.
    """
    loads = segments.where("memsz = filesz").groupBy("dump").agg(F.array_sort(F.collect_list(F.struct("vaddr", "paddr", "off", "memsz"))).alias("segments"))
    starts = ram.groupBy("dump").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    step = """aggregate(segments, named_struct('k', 0, 'taken', CAST(array() AS array<struct<map_offset: bigint, target_offset: bigint, length: bigint>>)),
      (acc, x) -> IF(acc.k < size(starts) AND (x.paddr = 0 OR x.paddr = get(starts, acc.k)),
        named_struct('k', acc.k + 1, 'taken', array_append(acc.taken, named_struct('map_offset', x.paddr, 'target_offset', x.off, 'length', x.memsz))), acc))"""
    return loads.join(starts, "dump").select("dump", F.explode(F.expr(step)["taken"]).alias("r")).select("dump", "r.*")


def readable_total(records: DataFrame, types: list[str]) -> DataFrame:
    """Bytes of memory records (kind, type, length) of kind ``efi`` whose type can be read, by type."""
    return records.where((F.col("kind") == "efi") & F.col("type").isin(types)).groupBy("type").agg(F.sum("length").alias("total"), F.count("*").alias("n"))
