"""Address maps kept up to date from a stream of writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from palimpsest.operators import ranges


def version(path: str, batch_id: int) -> str:
    return f"{path}/version={batch_id:020d}"


def overlay_batches(writes: DataFrame, path: str) -> DataStreamWriter:
    """A writer, to be started with a checkpoint location, that keeps the overlay of all batches under ``path``.

    Batch n reads version n-1, lays its writes (columns of ``ranges.overlay``) over it and writes version n whole, so a
    batch that runs again gives the same version. Writes of a batch are newer than those of all batches before.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        new = batch.select(*ranges.OUT, "seq").withColumn("seq", F.col("seq") + F.lit(1))
        if batch_id > 0:
            old = batch.sparkSession.read.parquet(version(path, batch_id - 1)).select(ranges.OUT)
            least = new.groupBy("map_urn").agg((F.min("seq") - 1).alias("seq"))
            new = new.unionByName(old.join(least, "map_urn", "left").withColumn("seq", F.coalesce("seq", F.lit(0).cast("bigint"))))
        ranges.overlay(new).write.mode("overwrite").parquet(version(path, batch_id))

    return writes.writeStream.foreachBatch(run)


def current(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(version(path, batch_id))
