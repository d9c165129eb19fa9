"""Cutting a plan by a table in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, one of our own in local mode; on a cluster that is an error,
    since executors would write to their own disks."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="coinfold-ck-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, so a lost executor costs a reread, not a recomputation, and what reads it twice computes
    it once. A Parquet table: Spark's own checkpoint computes the last stage twice and keeps rows as they lie in memory, several times as large."""
    return stored(df)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder: narrower on disk than a checkpoint, for wide results."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/coinfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    sweep(spark)
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that `stored` gave, when no plan reads it any more."""
    for f in df.inputFiles()[:1]:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Nudges the driver's collectors, so that Spark's cleaner drops the shuffle files of plans that were cut and are of no more use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_stored(spark: SparkSession) -> int:
    """Deletes the tables that `stored` wrote for this application, once no result is read from them any more; returns how many."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "coinfold-*"))
    for f in found:
        fs.delete(f.getPath(), True)
    return len(found)
