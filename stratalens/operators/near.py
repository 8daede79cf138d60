"""The k nearest within a radius, without a row for each pair within it.

Candidates come from blocks of points in numpy: the right side is cut into leaves of near points, a
bunch of left points takes its bound from its own leaf, and multiplies with the leaves that the bound
reaches.  What can be among the k nearest, by products of unit vectors that are a little wide, becomes
rows; the exact distance and the right id settle those few.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stratalens.functions import geo

#: Right points shipped to all tasks, or held by one; left points that a task takes at once.
POINTS, ASKED = 500_000, 100_000
#: Right points a leaf at least, left points a bunch, products at once, and what rounding can do to a product.
LEAF, BUNCH, CELLS, EDGE = 48, 256, 1 << 22, 1e-13


def k_nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_km: float, k: int) -> DataFrame:
    """The k nearest of right(right_id, rlat, rlon, ..) within the radius for left(left_id, lat, lon, ..), ties by the right id; adds ``km`` and ``rank`` from 1.

    A right side of at most POINTS is shipped to the tasks; a larger one is dealt in blocks, each of
    which meets every block of the left side in a task of its own.
    """
    spark = left.sparkSession
    known = lambda df, *cols: df.where(" and ".join(f"abs({c}) < double('infinity')" for c in cols))  # noqa: E731  null and NaN have no distance
    # Of points at one place no more than k can be among the k nearest.
    here = W.partitionBy("rlat", "rlon").orderBy(right_id)
    left, right = known(left, "lat", "lon"), known(right, "rlat", "rlon").withColumn("__n", F.row_number().over(here)).where(F.col("__n") <= k).drop("__n")
    n_left, n_right = left.count(), right.count()
    schema = T.StructType([*left.schema, *right.schema])
    least = math.cos(min(math.pi, radius_km / geo.EARTH_KM)) - EDGE
    if n_right <= POINTS:
        shipped = spark.sparkContext.broadcast(right.toArrow())
        tasks = max(spark.sparkContext.defaultParallelism, -(-n_left // ASKED))
        spread = left.repartitionByRange(tasks, F.floor(F.col("lat") / 3), "lon", left_id)
        met = spread.mapInArrow(lambda batches: _gathered(batches, shipped.value, k, least), schema)
    else:
        blocks = [-(-n_left // ASKED) or 1, -(-n_right // POINTS)]
        blocks[1] = max(blocks[1], -(-spark.sparkContext.defaultParallelism // blocks[0]))
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in blocks]
        a = left.withColumn("__l", deal(left_id, blocks[0])).withColumn("__r", every[1])
        b = right.withColumn("__r", deal(right_id, blocks[1])).withColumn("__l", every[0])
        names, more = left.columns, right.columns
        none = to_arrow_schema(schema)

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            found = list(_met(x.select(names), y.select(more), k, least)) if x.num_rows and y.num_rows else []
            return pa.Table.from_batches(found) if found else none.empty_table()

        met = a.groupBy("__l", "__r").cogroup(b.groupBy("__l", "__r")).applyInArrow(meet, schema)
    km = geo.haversine("lat", "lon", "rlat", "rlon")
    by = W.partitionBy(left_id).orderBy("km", right_id)
    return met.withColumn("km", km).where(F.col("km") <= radius_km).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _gathered(batches, right: pa.Table, k: int, least: float):
    """The batches of a task, ASKED rows at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ASKED:
            yield from _met(pa.Table.from_batches(held), right, k, least)
            held, n = [], 0
    if n:
        yield from _met(pa.Table.from_batches(held), right, k, least)


def _met(left: pa.Table, right: pa.Table, k: int, least: float):
    """Rows of both sides side by side, of the pairs that ``candidates`` gives."""
    if not right.num_rows:
        return
    vectors = [_unit(x.column(a).to_numpy(), x.column(b).to_numpy()) for x, a, b in ((left, "lat", "lon"), (right, "rlat", "rlon"))]
    mine, other, n = [], [], 0
    left, right = left.combine_chunks(), right.combine_chunks()

    def rows():
        a, b = left.take(pa.array(np.concatenate(mine))), right.take(pa.array(np.concatenate(other)))
        return pa.table([*a.columns, *b.columns], names=[*a.column_names, *b.column_names]).combine_chunks().to_batches()

    for i, j in candidates(*vectors, k, least):
        mine.append(i)
        other.append(j)
        n += len(i)
        if n >= 1 << 16:
            yield from rows()
            mine, other, n = [], [], 0
    if n:
        yield from rows()


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat.astype(np.float64)), np.radians(lon.astype(np.float64))
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def candidates(asked: np.ndarray, points: np.ndarray, k: int, least: float):
    """(rows of ``asked``, rows of ``points``), piece by piece: the pairs of unit vectors that can be among the k nearest of one asked and whose product is at least ``least``."""
    leaves, bunches = [], []
    leaf = max(LEAF, 24 * len(points) // max(1, len(asked)))  # few asked: larger leaves, so that a bunch is not one point
    todo = [(np.arange(len(points)), np.arange(len(asked)))]
    while todo:
        r, a = todo.pop()
        x = points[r]
        axis = int(np.argmax(np.ptp(x, axis=0)))
        x = x[:, axis]
        if len(r) <= leaf or x.min() == x.max():
            leaves.append(r)
            bunches.append(a)
            continue
        cut = np.partition(x, len(x) // 2)[len(x) // 2]
        low = x < cut if cut > x.min() else x <= cut
        below = asked[a, axis] < cut
        todo += [(r[low], a[below]), (r[~low], a[~below])]
    centres = np.array([points[r].mean(0) for r in leaves])
    wide = np.array([np.sqrt(((points[r] - c) ** 2).sum(1).max()) for r, c in zip(leaves, centres, strict=True)])
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    for own, a in zip(leaves, bunches, strict=True):
        if len(a) > BUNCH:
            a = a[np.argsort(asked[a, int(np.argmax(np.ptp(asked[a], axis=0)))])]
        for at in range(0, len(a), BUNCH):
            bunch = a[at : at + BUNCH]
            q = asked[bunch]
            middle = q.mean(0)
            bound = reach
            if len(own) >= k:
                kth = np.partition(q @ points[own].T, len(own) - k, axis=1)[:, len(own) - k].min()
                bound = min(reach, math.sqrt(max(0.0, 2 - 2 * kth)) + 1e-6)
            far = np.sqrt(((centres - middle) ** 2).sum(1)) - wide
            near = np.flatnonzero(far <= bound + np.sqrt(((q - middle) ** 2).sum(1).max()))
            if not len(near):
                continue
            met = np.concatenate([leaves[i] for i in near])
            step = max(1, CELLS // len(met))
            for b in range(0, len(bunch), step):
                score = q[b : b + step] @ points[met].T
                edge = np.full(len(score), least)
                if len(met) > k:
                    edge = np.maximum(edge, np.partition(score, len(met) - k, axis=1)[:, len(met) - k] - EDGE)
                i, j = np.nonzero(score >= edge[:, None])
                yield bunch[b : b + step][i], met[j]
