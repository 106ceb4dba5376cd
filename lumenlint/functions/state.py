"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session names none and everything runs in one JVM."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="lumenlint-")
    spark.conf.set("spark.checkpoint.dir", at)
    _remove_at_exit(spark, at)
    return at


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may have ended before Python does
            pass

    atexit.register(remove)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor takes nothing along."""
    path = f"{shared_dir(df.sparkSession)}/lumenlint-{uuid.uuid4().hex}/{name}"
    _remove_at_exit(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
