"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only one local process without that setting gets a private folder; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='stratalens-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below ``shared_dir``; it goes when the driver's JVM ends in order."""
    path = f"{shared_dir(spark)}/stratalens/{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        _MARKED.add(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the run's folder that nothing has."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: later plans start from its files."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
