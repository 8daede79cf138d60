"""What the training-data operators share: shared storage, model shipping, batch helpers."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.shared import run_dir, shared_dir  # noqa: F401  operators and tests take them from here

#: Removes the shuffle files of a finished write, so that only the written table keeps disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@contextlib.contextmanager
def cleanup(spark: SparkSession):
    """Within this, a write removes its own shuffle files when it is done."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The plan above starts from files, so a lost executor costs at most the tasks it ran, and
    values that depend on the run (row locators) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        files, where = _files(table.sparkSession, table._written)
        files.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(name: str = "doc_id"):
    """True where crc32 of the id's decimal text is a multiple of 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def parts(batches: Iterator[pa.RecordBatch], column: str, most_rows: int = 256, most_chars: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that a piece has few rows and little text (one row at least); null text is ``""``."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i in range(batch.num_rows + 1):
            if i == batch.num_rows or (i > start and (i - start >= most_rows or total + sizes[i] > most_chars)):
                if i > start:
                    piece = batch.slice(start, i - start)
                    yield piece, [x or "" for x in values.slice(start, i - start).to_pylist()]
                start, total = i, 0
            if i < batch.num_rows:
                total += sizes[i]


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def keep_rows(docs: DataFrame, key: Column, winners: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, key) is among ``winners`` (doc_id, key, n), with all their columns.

    ``n`` is how many rows have that id and key: of several one stays, and only those few go
    through a grouping.  ``winners`` has a row a group, so a plain shuffle join splits hot keys.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    keyed = docs.select(F.col("doc_id").alias("__id"), key.alias("__key"), own)
    w = winners.select(F.col("doc_id").alias("__wid"), F.col("key").alias("__wkey"), F.col("n").alias("__n"))
    kept = keyed.join(w.hint("shuffle_merge"), F.col("__id").eqNullSafe(F.col("__wid")) & (F.col("__key") == F.col("__wkey")))
    if winners.where("n > 1").isEmpty():
        return kept.select("__doc.*")
    several = kept.where("__n > 1").groupBy("__id", "__key").agg(F.any_value("__doc").alias("__doc"))
    return kept.where("__n = 1").select("__doc.*").union(several.select("__doc.*"))
