"""Cutting lineage for loops, in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """A checkpoint of ``df`` that remembers, if ``dealt``, by which columns its rows are dealt and sorted, so that what meets them there isn't shuffled again. It lies under ``spark.checkpoint.dir``. Unset, a local master gets a temporary folder; on a cluster that is an error, as no other folder is known to be shared."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lineage-"))
    if not dealt:
        return df.checkpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans settle their partitions as they run, and tell a checkpoint of none
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing reads any more."""
    at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
