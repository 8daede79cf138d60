"""Sinks: refuse to overwrite, roll files, resume, keep private columns in."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a public table must not have.
PRIVATE = frozenset({"truth", "truth_lat", "truth_lon", "answer", "label_private"})


def cache_with_manifest(df: DataFrame, path: str, manifest: dict) -> None:
    """A table and its manifest, both refused if there already."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/data")
    lines = df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True, separators=(",", ":")),)], "value string")
    lines.coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def rolling_parts(df: DataFrame, path: str, rows: int = 2_000_000) -> None:
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Keys in sorted order, compact."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def release_csv(df: DataFrame, path: str, order: str) -> None:
    """One file, in the order of a random id; for small releases."""
    df.orderBy(order).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key is not stored yet; returns how many.  A rerun after a loss appends only the rest."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        df = df.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    return n


def overwrite_parts(df: DataFrame, path: str, part: str) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def public_private(df: DataFrame, public_path: str, private_path: str, key: str) -> DataFrame:
    """Two tables, and digests of their rows; the public one has no private column."""
    hidden = [c for c in df.columns if c in PRIVATE]
    public = df.drop(*hidden)
    assert_public(public)
    public.write.mode("errorifexists").parquet(public_path)
    df.select(key, *hidden).write.mode("errorifexists").parquet(private_path)
    one = lambda x, name: x.select(F.lit(name).alias("table"), F.sha2(F.to_json(F.struct(*x.columns)), 256).alias("h")).groupBy("table").agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring("h", 1, 8), 16, 10).cast("long")).alias("digest"))
    return one(public, "public").unionByName(one(df.select(key, *hidden), "private"))


def assert_public(df: DataFrame) -> None:
    if found := PRIVATE & set(df.columns):
        raise ValueError(f"private columns in a public table: {sorted(found)}")


def clustered_table(df: DataFrame, name: str, key: str, buckets: int, path: str) -> None:
    """A table bucketed and sorted by a lookup key, with its files at ``path``: later joins on it need no shuffle of this side."""
    df.write.mode("errorifexists").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def replace_whole(df: DataFrame, path: str) -> None:
    """The table at ``path`` appears, or is replaced, as a whole: written beside it, then renamed.  A failed write leaves what was there."""
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.option("compression", "zstd").parquet(beside)
    files, new, old = _place(spark, beside)[0], _place(spark, beside)[1], _place(spark, path)[1]
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{beside} could not be renamed to {path}")


def staged_copy(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Copy the files of a folder, and accept the copy only if every file has its size; returns the sizes."""
    files, src = _place(spark, source)
    there, dst = _place(spark, target)
    if there.exists(dst):
        raise FileExistsError(target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, src, there, dst, False, spark._jsc.hadoopConfiguration())
    sizes = lambda fs, p: {x.getPath().getName(): x.getLen() for x in fs.listStatus(p) if x.isFile()}
    want, got = sizes(files, src), sizes(there, dst)
    if want != got:
        there.delete(dst, True)
        raise OSError(f"{target} is not {source}")
    return got


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
