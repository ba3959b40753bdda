"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and all run on this machine."""
    sc = spark.sparkContext
    if (configured := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return configured
    if (known := sc._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="hexlode-")
    sc.setCheckpointDir(made)
    return made


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared one; the folder goes when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df computed once: written as Parquet, and read back without its lineage; the files go when the driver ends."""
    folder = fresh_dir(df.sparkSession, "settled")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
