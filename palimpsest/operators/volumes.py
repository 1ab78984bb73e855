"""Volumes: resolution of a stream's storage, merging, and splitting into parts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.grouping import spread
from palimpsest.plans.lineage import cut
from palimpsest.vocabulary import ABSTRACT_IMAGES, DATA_STREAM, FILE, IMAGE_STREAMS, MAP, STORED, SYMBOLIC, SYMBOLIC_PREFIX, TYPE, ZIP_SEGMENT


def symbolic_kind(urn) -> Column:
    u = F.col(urn) if isinstance(urn, str) else urn
    return F.when(u.isin(list(SYMBOLIC)) | u.rlike(f"^{SYMBOLIC_PREFIX}[0-9A-F]{{2}}$"), "symbolic")


def classify(triples: DataFrame) -> DataFrame:
    """(s, kind, next): what each subject's types, in order of seq, open first; ``next`` is the stream of an abstract image."""
    last = lambda p: F.max_by(F.when(F.col("p") == p, F.col("o")), F.when(F.col("p") == p, F.col("seq")))
    kinds = F.collect_list(F.when(F.col("p") == TYPE, F.struct("seq", "o")))
    rows = spread(triples.select("s", "p", "o", "seq"), "s").groupBy("s").agg(F.transform(F.array_sort(kinds), lambda x: x["o"]).alias("types"), last(DATA_STREAM).alias("stream"), last(STORED).alias("owner"))
    types = F.when(F.size("types") == 0, F.array(F.lit(ZIP_SEGMENT))).otherwise(F.col("types"))
    usable = F.transform(
        types,
        lambda t: F.when(t.isin(IMAGE_STREAMS), "image")
        .when(t.isin(ABSTRACT_IMAGES) & F.col("stream").isNotNull(), "delegate")
        .when(t == MAP, "map")
        .when(t.isin(ZIP_SEGMENT, FILE) & F.col("owner").isNotNull(), "segment"),
    )
    kind = F.get(F.array_compact(usable), F.lit(0))
    return rows.select("s", kind.alias("kind"), F.when(kind == "delegate", F.col("stream")).alias("next"))


def resolve(triples: DataFrame) -> DataFrame:
    """(s, stream, kind, hops): follows data streams, however many, to a concrete stream; ``not_found`` for none and for cycles.

    Pointers double in each round, so a chain of n hops takes log2(n) joins, and each round is written to the checkpoint
    folder. While an open chain has an end, its last open subject closes; a round in which none does leaves cycles only.
    """
    open_kind = F.when(F.col("kind") == "delegate", None).otherwise(F.coalesce("kind", symbolic_kind("s"), F.lit("not_found")))
    state = cut(classify(triples).select("s", F.coalesce("next", "s").alias("stream"), open_kind.alias("kind"), F.when(F.col("kind") == "delegate", 1).otherwise(0).cast("bigint").alias("hops")))
    left = state.where("kind IS NULL").count()
    while left:
        todo = state.where("kind IS NULL")
        onward = state.select(F.col("s").alias("stream"), F.col("stream").alias("to"), F.col("kind").alias("k"), F.col("hops").alias("h"))
        step = todo.select("s", "stream", "hops").join(onward, "stream", "left")
        kind = F.when(F.col("h").isNull(), F.coalesce(symbolic_kind("stream"), F.lit("not_found"))).otherwise(F.col("k"))
        moved = step.select("s", F.coalesce("to", "stream").alias("stream"), kind.alias("kind"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"))
        state = cut(state.where("kind IS NOT NULL").unionByName(moved))
        before, left = left, state.where("kind IS NULL").count()
        if left == before:
            break
    return state.withColumn("kind", F.coalesce("kind", F.lit("not_found")))


def add_volumes(segments: DataFrame, more: DataFrame) -> DataFrame:
    """Segments of two groups of volumes; a volume that the first has already is not taken again."""
    fresh = more.join(segments.select("volume").distinct(), "volume", "left_anti")
    return segments.unionByName(fresh)


def split_parts(segments: DataFrame, key: list[str], size: str, limit: int, group: str | None = None) -> DataFrame:
    """Adds ``part``: a segment opens the next part when the current one has reached ``limit``.

    The rule is a sequential fold over the segments of a ``group`` (an output volume) in order of ``key``. Groups are
    dealt to tasks and sorted by Spark; the fold keeps two numbers, so a group of any length is never held in memory.
    """
    by = group or "_all"
    rows = segments.withColumn("_all", F.lit(0)).select(by, *key, F.col(size).cast("bigint").alias("_size"))
    rows = rows.repartition(by).sortWithinPartitions(by, *key)

    def run(batches):
        now, part, used = object(), 0, 0
        for batch in batches:
            parts = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if g != now:
                    now, part, used = g, 0, 0
                elif used >= limit:
                    part, used = part + 1, 0
                used += n or 0
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(parts, pa.int32())], [by, *key, "part"])

    own = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (by, *key))
    out = rows.mapInArrow(run, f"{own}, part int")
    return out if group else out.drop("_all")


def part_name(name: str, part: int) -> str:
    """Path of part n of a split volume: the first keeps the name."""
    return name if part == 0 else f"{name}.A{part:02d}"
