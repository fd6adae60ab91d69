"""A session with the settings that the engine counts on."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, times in UTC; without ``shuffle_partitions`` the cluster's setting holds and adaptive execution merges small ones."""
    b = SparkSession.builder.appName("loomtext").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a session of one process (``local[...]``) gets one that goes when it ends.

    On a cluster an unset folder raises, as one of a single machine would not do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomtext-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, so that several readers do not compute it again."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def carried(module: str) -> None:
    """Workers get the classes of ``module`` with the job, so they need not have the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
