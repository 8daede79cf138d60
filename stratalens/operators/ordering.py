"""Places and running sums in a global order, without a single task.

Ranges of the order are sorted each in a task of its own and written once; what a row needs of the
rows before its range is one number a range, and the rest is within the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.sources.shared import fresh


def _ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` written in order, with ``__range`` and the place ``__at`` (from 0) in it."""
    spark = df.sparkSession
    path = fresh(spark, "order")
    df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema, T.StructField("__at", T.LongType())])).parquet(path)
    return rows.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))


def _with_before(rows: DataFrame, what: Column, kind: str) -> DataFrame:
    """Adds ``__before``: the sum of ``what`` over all earlier ranges."""
    before, starts = 0, []
    for r in sorted(rows.groupBy("__range").agg(what).collect()):  # one row a range
        starts.append((r[0], before))
        before += r[1]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(starts, f"__range long, __before {kind}")), "__range")


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """All rows of ``df`` with their place, from 1, in the order.  The order must leave no ties."""
    found = _with_before(_ranges(df, *order), F.count("*"), "long")
    return found.withColumn(name, F.col("__before") + F.col("__at") + 1).select(*df.columns, name)


def summed(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """All rows with the sum of a whole-number ``value`` over the rows before them."""
    found = _with_before(_ranges(df, order), F.sum(F.col(value).cast("long")), "long")
    within = F.sum(F.col(value).cast("long")).over(W.partitionBy("__range").orderBy("__at").rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn(name, F.col("__before") + F.coalesce(within, F.lit(0))).select(*df.columns, name)
