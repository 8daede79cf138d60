"""Incremental scans as Structured Streaming: a file source, a checkpoint, dedup by id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from stratalens.sources.shared import written


def new_rows(spark: SparkSession, folder: str, schema: str, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows of files as they arrive, each key once.  With a time column, keys are remembered for ``late`` only, so state stays bounded."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


def append_to(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def counts_by_window(spark: SparkSession, folder: str, schema: str, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))


def budgets(steps: DataFrame, key: str, cost: str, credits: float) -> DataFrame:
    """Per-key running budget over a stream of steps: (key, spent, left, allowed) for each arriving group of steps."""

    def run(k, batches, state):
        spent = state.get[0] if state.exists else 0.0
        for pdf in batches:
            spent += float(pdf[cost].sum())
        state.update((spent,))
        yield pd.DataFrame({key: [k[0]], "spent": [spent], "left": [max(0.0, credits - spent)], "allowed": [spent <= credits]})

    kind = steps.schema[key].dataType.simpleString()
    return steps.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, spent double, left double, allowed boolean", "spent double", "update", GroupStateTimeout.NoTimeout)


def fold_budget(actions, credits: float):
    """The same fold over an ordered array of costs, as an expression: the count of actions within the budget."""
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0).alias("n"))
    return F.aggregate(actions, start, lambda s, x: F.when(s.spent + x <= credits, F.struct((s.spent + x).alias("spent"), (s.n + 1).alias("n"))).otherwise(F.struct(F.lit(1e18).alias("spent"), s.n.alias("n"))), lambda s: s.n)


def backoff(attempt, retry_after=None, base: float = 2.0, cap: float = 30.0):
    """Seconds to wait before attempt ``attempt`` (from 0) is made again: what the answer asked for, else the attempt's multiple of ``base``, at most ``cap``."""
    own = F.least(F.lit(cap), base * (attempt + 1))
    return own if retry_after is None else F.coalesce(F.greatest(retry_after, F.lit(0.0)), own)


def paced(requests: DataFrame, group: str, made: str, step: float, tie: str, start: str = "start") -> DataFrame:
    """When each request of a group may start if starts are a ``step`` apart at least and none is before its request was made.

    start_i = max over j <= i of made_j + (i - j) * step, a running maximum.
    """
    by = W.partitionBy(group).orderBy(made, tie)
    numbered = requests.withColumn("__i", (F.row_number().over(by) - 1).cast("long")).withColumn("__free", F.col(made) - F.col("__i") * step)
    latest = F.max("__free").over(by.rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn(start, latest + F.col("__i") * step).drop("__i", "__free")


def worked(rows: DataFrame, workers: int, key: str, work) -> DataFrame:
    """``work(worker, batches)`` gives (result long) rows a worker; each ends with a sentinel row (result null) that says how many there were.

    Raises if a worker did not end, or its results are not as many as it said: the check that a
    consumer makes of its queue.
    """

    def run(batches):
        from pyspark import TaskContext

        me, n = TaskContext.get().partitionId(), 0
        for r in work(me, batches):
            n += 1
            yield pd.DataFrame({"worker": [me], "result": pd.array([r], dtype="Int64"), "said": pd.array([None], dtype="Int64")})
        yield pd.DataFrame({"worker": [me], "result": pd.array([None], dtype="Int64"), "said": pd.array([n], dtype="Int64")})

    out = written(rows.repartition(workers, key).mapInPandas(run, "worker int, result long, said long"), "worked")
    ended = out.groupBy("worker").agg(F.count("result").alias("n"), F.max("said").alias("said")).collect()  # a row a worker
    if sorted(r.worker for r in ended) != list(range(workers)) or any(r.said != r.n for r in ended):
        raise RuntimeError(f"workers that did not end: {ended}")
    return out.where("result is not null").select("worker", "result")
