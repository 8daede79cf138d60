"""Scores of predictions: thresholds, weighted means with clustered errors, ranks, bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.operators import ordering

THRESHOLDS_KM = (1, 25, 200, 750, 2500)


def threshold_shares(km="km", thresholds=THRESHOLDS_KM) -> list[Column]:
    """Share strictly under each threshold."""
    return [F.avg((F.col(km) < t).cast("int")).alias(f"under_{t}") for t in thresholds]


def clustered(rows: DataFrame, y: str, stratum: str, group: str) -> DataFrame:
    """Mean with equal weight for strata, and its error clustered by group: residuals from the stratum's mean, weighted, summed a group, root of squares."""
    strata = rows.agg(F.count_distinct(stratum).alias("k"))
    per = rows.groupBy(stratum).agg(F.count("*").alias("n"), F.avg(y).alias("m"))
    weighted = rows.join(per, stratum).join(F.broadcast(strata)).withColumn("w", 1 / (F.col("k") * F.col("n")))
    by_group = weighted.groupBy(group).agg(F.sum(F.col("w") * F.col(y)).alias("mean"), F.sum(F.col("w") * (F.col(y) - F.col("m"))).alias("r"))
    return by_group.agg(F.sum("mean").alias("mean"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("se"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with mid-ranks for ties, from counts by score: no global sort of the rows, and a running sum by ranges of scores."""
    by = rows.groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    part = ordering.summed(by, score, "neg", "below").withColumn("u", F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return part.agg((F.sum("u") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, row_id: str, query: str | None = None) -> DataFrame:
    """Mean precision at the positives, in order of score (ties by id); one value a query or in all."""
    keys = [query] if query else []
    by = W.partitionBy(*keys).orderBy(F.desc(score), row_id)
    ranked = rows.withColumn("rn", F.row_number().over(by)).withColumn("hits", F.sum(label).over(by.rowsBetween(W.unboundedPreceding, 0)))
    total = F.sum(F.col("hits") / F.col("rn") * F.col(label)) / F.sum(label)
    return ranked.groupBy(*keys).agg(F.coalesce(total, F.lit(0.0)).alias("ap"))


def ordinal_auc(rows: DataFrame, score: str, label: str, row_id: str) -> DataFrame:
    """The same with ties ordered by id: negatives below each positive, within its score by a window and below it by counts a score."""
    within = F.sum(1 - F.col(label)).over(W.partitionBy(score).orderBy(row_id).rowsBetween(W.unboundedPreceding, -1))
    x = rows.withColumn("__w", F.when(F.col(label) == 1, F.coalesce(within, F.lit(0))))
    by = x.groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"), F.sum("__w").alias("w")).withColumn("neg", F.col("n") - F.col("pos"))
    part = ordering.summed(by, score, "neg", "below").withColumn("u", F.coalesce("w", F.lit(0)) + F.col("pos") * F.col("below"))
    return part.agg((F.sum("u") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, ..
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9))


def bootstrap(rows: DataFrame, value: str, row_id: str, resamples: int) -> DataFrame:
    """Mean of a value and the 95 % interval of its resampled means, in one pass.

    In each resample a row counts a Poisson number of times, drawn from a digest of its id and the
    resample (four resamples a digest).  A row is drawn for itself, so nothing is numbered or
    joined, and a task sends four sums a digest whatever it read.
    """
    blocks = -(-resamples // 4)
    digest = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(":"), F.col("b").cast("string")))
    v = F.col(value).cast("double")
    # A row becomes ``blocks`` rows: a file that one task would read is dealt to many first.
    dealt = rows.select(v.alias("v"), row_id).repartition(max(32, 4 * rows.sparkSession.sparkContext.defaultParallelism), row_id)
    drawn = dealt.select("v", row_id, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).select("v", "b", digest.alias("h"))
    # A share of 2**32 reaches a chance where its eight hex digits reach those of the chance: text is compared, most often once or twice.
    edges = [f"{math.ceil(c * 4294967296):08x}" for c in POISSON]
    counts = []
    for k in range(4):
        h = F.substring("h", 1 + 8 * k, 8)
        w = F.when(h < edges[0], 0)
        for i, edge in enumerate(edges[1:], 1):
            w = w.when(h < edge, i)
        counts.append(w.otherwise(len(edges)).alias(f"w{k}"))
    drawn = drawn.select("v", "b", *counts)
    aggs = [F.struct((F.lit(4) * F.first("b") + k).alias("r"), (F.sum(F.col("v") * F.col(f"w{k}")) / F.sum(f"w{k}")).alias("m")) for k in range(4)]
    means = drawn.groupBy("b").agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).where(F.col("x.r") < resamples)
    interval = means.agg(F.percentile("x.m", 0.025).alias("low"), F.percentile("x.m", 0.975).alias("high"))
    return rows.agg(F.avg(v).alias("mean")).join(F.broadcast(interval))  # one row each
