"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives lost executors: a later stage reads files, not shuffle blocks of a machine that is gone.
The folder comes from ``spark.checkpoint.dir``; only where a local session has none (tests) a default is set. On a cluster without it the
executors' own disks would be no shared folder, so that raises.
"""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULT = "/tmp/checkpoints"


def folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _DEFAULT
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/skyloom-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_skyloom_scratch"):
        sc._skyloom_scratch = []
    return sc._skyloom_scratch


def materialize(df: DataFrame, kind: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; zstd for large tables of little entropy."""
    spark = df.sparkSession
    path = folder(spark, kind)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, after which Spark deletes shuffle files that no plan needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every scratch folder that this session has made; their DataFrames can't be read afterwards."""
    jvm = spark._jvm
    for path in _made(spark):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made(spark).clear()
