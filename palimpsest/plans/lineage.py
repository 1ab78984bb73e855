"""Cutting of lineage through the shared folder."""

from __future__ import annotations

import tempfile
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions.
LOCAL: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may go without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if spark not in LOCAL:
        LOCAL[spark] = tempfile.mkdtemp(prefix="shared-")
    return LOCAL[spark]


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to the cluster's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
