"""Helpers shared by the operators: reading tables, normalising text, and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of every contract here: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word, as a Java, Python and RE2 regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where ids are ordered or joined: such rows sort last and count as one document.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table as it is read, or dealt by rows if its files make fewer partitions than there are cores.

    For tables whose rows cost much more to work on than to move. Those of few files are small, so little is moved.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does that on its own when every character is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def n_words(c: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. One of our own only where the session names none and everything runs in one JVM."""
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
        except Exception:  # the JVM may have ended before Python does; what is left is the shared folder's to clean
            pass

    atexit.register(remove)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lumenlint-{uuid.uuid4().hex}/{name}"
    _remove_at_exit(spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor takes nothing along."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
