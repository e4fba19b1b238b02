"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file:/tmp/checkpoints/barloom-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stash(df: DataFrame, label: str, let_go: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there; ``let_go``: large shuffles can go at once."""
    spark = df.sparkSession
    path = f"{root(spark)}/barloom/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    if let_go:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._barloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "_barloom_path", None)
        if path:
            spark = table.sparkSession
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
