"""Exact vector search.

Vectors meet in blocks: a query block of at most ``QUERY_BYTES`` (counted before it is shipped)
is multiplied with the gallery's Arrow batches by numpy, so that no pair is worked out by itself.
``nearest`` keeps the best k of a query within each task and merges those; ``scored`` gives the
pairs of a stated query set themselves, for predicates that need both sides.  Of many queries the
gallery is shipped, if it fits, so that a query's list is whole within one task; if it does not,
blocks of both sides meet, all of them in one job and as many pairs of blocks in every task.

Scores are rounded to twelve places: equal vectors then score equally whatever block they are in,
and ties go to the smaller item.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions import geo

#: Bytes of query vectors that meet the gallery at once, and gallery rows that are multiplied at once.
QUERY_BYTES, ROWS = 64 << 20, 2048
#: Gallery rows of a tile: its products with ROWS / 2 queries stay in a core's cache until they are looked at.
TILE = 256


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length to a matrix of doubles; what is not a number counts as 0."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.nan_to_num(values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0), nan=0.0)


def _few(queries: DataFrame, width: int) -> bool:
    """Whether the query vectors fit one block; counts no further than that."""
    most = max(1, QUERY_BYTES // (8 * max(1, width)))
    return queries.limit(most + 1).count() <= most


def _dealt(items: DataFrame) -> DataFrame:
    """``items`` in as many parts as tasks can run: products with many queries cost more than moving a vector."""
    tasks = items.sparkSession.sparkContext.defaultParallelism
    return items if items.rdd.getNumPartitions() >= tasks else items.repartition(tasks)


def _width(vectors: DataFrame, column: str) -> int:
    found = vectors.select(F.size(column).alias("n")).where("n > 0").first()
    return found["n"] if found else 0


def scored(queries: DataFrame, gallery: DataFrame, predicate: Column | None = None) -> DataFrame:
    """queries(qid, qvec, ..) against gallery(gid, gvec, ..) under a predicate over both; adds ``score`` (dot product).

    For a stated query set.  The query side is shipped only within QUERY_BYTES, else it is dealt in
    blocks that meet the gallery one after the other; the vectors are not in the result.
    """
    spark = queries.sparkSession
    width = _width(queries, "qvec")
    most = max(1, QUERY_BYTES // (8 * max(1, width)))
    blocks = 1 if _few(queries, width) else -(-queries.count() // (max(1, most // 2)))
    out = None
    q_fields = [f for f in queries.schema if f.name != "qvec"]
    g_fields = [f for f in gallery.schema if f.name != "gvec"]
    schema = T.StructType([*g_fields, *q_fields, T.StructField("score", T.DoubleType())])
    for k in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
        shipped = spark.sparkContext.broadcast(mine.toArrow())
        got = gallery.select(*[f.name for f in g_fields], "gvec").mapInArrow(_pairs(shipped, len(g_fields)), schema)
        out = got if out is None else out.union(got)
    return out if predicate is None else out.where(predicate)


def _pairs(shipped, n_gallery: int):
    def run(batches):
        asked = shipped.value
        q = _matrix(asked.column("qvec"))
        asked = asked.drop_columns(["qvec"]).combine_chunks()
        for batch in batches:
            step = max(1, ROWS * 32 // max(1, len(q)))
            for a in range(0, batch.num_rows if len(q) else 0, step):
                part = batch.slice(a, step)
                score = (_matrix(part.column(n_gallery)) @ q.T).round(12)
                g_at, q_at = np.divmod(np.arange(score.size), len(q))
                rows = part.select(range(n_gallery)).take(pa.array(g_at))
                cols = [*rows.columns, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in asked.take(pa.array(q_at)).columns), pa.array(score.ravel())]
                yield pa.RecordBatch.from_arrays(cols, names=[*rows.schema.names, *asked.schema.names, "score"])

    return run


def nearest(queries: DataFrame, gallery: DataFrame, k: int, guard: bool = False, own: bool = False) -> DataFrame:
    """(qid, gid, score, rank): the best k of the gallery for each of queries(qid, qvec[, qauthor]), ties by gid.

    ``guard`` leaves out rows (gid, gvec, gauthor) of the query's author (an unknown author excludes
    nothing), ``own`` the row of the query's own id.  A task gives k rows a query at most, whatever
    it read; the merge is a group limit.
    """
    spark = queries.sparkSession
    width = _width(queries, "qvec")
    authors = ["qauthor"] if guard else []
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "qvec", *[F.col(c).cast("string") for c in authors])
    items = gallery.select(F.col("gid").cast("long").alias("gid"), "gvec", *([F.col("gauthor").cast("string").alias("gauthor")] if guard else []))
    fields = "qid long, gid long, score double"
    tasks = spark.sparkContext.defaultParallelism
    if asked.limit(ROWS + 1).count() > ROWS and _few(items, width):
        # A running list over the whole gallery meets few rows that enter it; one a part of the gallery meets many.
        shipped = spark.sparkContext.broadcast(items.toArrow())

        def search(batches):
            for part in _slices(batches, ROWS * 4):
                yield from _best(part, shipped.value.to_batches(), k, guard, own)

        best = asked.repartition(4 * tasks, "qid").mapInArrow(search, fields)
    elif _few(asked, width):
        shipped = spark.sparkContext.broadcast(asked.toArrow())
        best = _dealt(items).mapInArrow(lambda batches: _best(shipped.value, batches, k, guard, own), fields)
    else:
        # Blocks of both sides by hash, every pair of blocks a group and a partition of its own: a vector is sent
        # once a block of the other side, and a task holds two blocks, however many vectors there are.
        blocks = [max(1, -(-df.count() * 8 * width // QUERY_BYTES)) for df in (asked, items)]
        blocks[0] = max(blocks[0], -(-2 * tasks // blocks[1]))
        n = blocks[0] * blocks[1]
        pair = F.element_at(F.array(*[F.lit(x) for x in _one_each(spark, n)]), F.col("bq") * blocks[1] + F.col("bg") + 1).alias("pair")
        all_of = [F.explode(F.sequence(F.lit(0), F.lit(m - 1))) for m in blocks]
        left = asked.withColumn("bq", F.pmod(F.xxhash64("qid"), F.lit(blocks[0])).cast("int")).withColumn("bg", all_of[1]).select(pair, *asked.columns)
        right = items.withColumn("bg", F.pmod(F.xxhash64("gid"), F.lit(blocks[1])).cast("int")).withColumn("bq", all_of[0]).select(pair, *items.columns)

        def meet(x: pa.Table, y: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(_best(x, y.to_batches(), k, guard, own)) if x.num_rows else [], schema=_BEST)

        best = left.repartition(n, "pair").groupBy("pair").cogroup(right.repartition(n, "pair").groupBy("pair")).applyInArrow(meet, fields)
    by = W.partitionBy("qid").orderBy(F.desc("score"), "gid")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _one_each(spark: SparkSession, n: int) -> list[int]:
    """``n`` different whole numbers that a shuffle by them deals to ``n`` partitions, one to each."""
    of = spark.range(32 * n + 64).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x").alias("x"))
    found = {r["p"]: r["x"] for r in of.collect()}
    return [found.get(p, -1 - p) for p in range(n)]


_BEST = pa.schema([("qid", pa.int64()), ("gid", pa.int64()), ("score", pa.float64())])


def _best(asked: pa.Table, batches, k: int, guard: bool, own: bool):
    """The best k of all batches for each query, in numpy: a running list of k a query and the next batch's scores."""
    q = _matrix(asked.column("qvec"))
    qid = asked.column("qid").to_numpy()
    if not len(qid):
        return
    if guard:
        names: dict[str, int] = {}
        code = lambda c, none: np.array([none if x is None else names.setdefault(x, len(names)) for x in c.to_pylist()], np.int64)
        q_author = code(asked.column("qauthor"), -1)
    top = np.full((len(qid), k), -np.inf)
    ids = np.full((len(qid), k), np.iinfo(np.int64).max)
    q_norm = np.sqrt((q**2).sum(axis=1))
    with np.errstate(over="ignore"):  # then it is not used
        single = q.astype(np.float32)
    held = np.empty((ROWS // 2, TILE), np.float32)
    for part in _slices(batches, ROWS * 2):
        gid = part.column("gid").to_numpy(zero_copy_only=False)
        g = _matrix(part.column("gvec"))
        if guard:
            g_author = code(part.column("gauthor"), -2)
        # Products of half the precision are cheap and off by this much at most; those that can be among the best are worked out again.
        most = float(np.sqrt((g**2).sum(axis=1)).max(initial=0.0))
        half = most < 1e15 and q_norm.max() < 1e15
        rough, g_rough = (single, g.astype(np.float32).T) if half else (q, g.T)
        off = 2 * (q.shape[1] + 4) * (6e-8 if half else 1.2e-16) * most * q_norm + 1e-11
        tiles = [np.ascontiguousarray(g_rough[:, c : c + TILE]) for c in range(0, len(gid), TILE)] if half else []
        for a in range(0, len(qid), ROWS // 2):
            rows = slice(a, a + ROWS // 2)
            least = top[rows, k - 1] - off[rows]
            new = np.flatnonzero(np.isneginf(least))
            if len(new) or not half:
                score = rough[rows] @ g_rough
                if len(new) and len(gid) > k:  # no k yet: the k-th of this part is a bound as well
                    first = score[new]
                    if guard:
                        first[q_author[rows][new, None] == g_author[None, :]] = -np.inf
                    if own:
                        first[qid[rows][new, None] == gid[None, :]] = -np.inf
                    least[new] = np.partition(first, len(gid) - k, axis=1)[:, len(gid) - k] - 2 * off[rows][new]
                hits = np.flatnonzero(score >= least.astype(score.dtype)[:, None])
            else:
                hits = _hits(single[rows], tiles, least.astype(np.float32), len(gid), held)
            for at in range(0, len(hits), 1 << 17):
                i, j = np.divmod(hits[at : at + (1 << 17)], len(gid))
                i += a
                if guard or own:
                    ok = np.ones(len(i), bool)
                    if guard:
                        ok &= q_author[i] != g_author[j]
                    if own:
                        ok &= qid[i] != gid[j]
                    i, j = i[ok], j[ok]
                exact = np.einsum("ij,ij->i", q[i], g[j]).round(12)
                ok = exact >= top[i, k - 1]
                if ok.any():
                    _merge(top, ids, i[ok], exact[ok], gid[j[ok]])
    found = np.isfinite(top)
    rows = np.nonzero(found)[0]
    for a in range(0, len(rows), 1 << 16):
        at = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(qid[rows[at]]), pa.array(ids[found][at]), pa.array(top[found][at])], schema=_BEST)


def _hits(q: np.ndarray, tiles: list[np.ndarray], least: np.ndarray, width: int, held: np.ndarray) -> np.ndarray:
    """Places (row * width + column) where q @ tiles reaches the row's ``least``; most rows are passed over by their largest product."""
    found = []
    for c, tile in enumerate(tiles):
        whole = len(q) == len(held) and tile.shape[1] == TILE
        score = np.matmul(q, tile, out=held) if whole else q @ tile
        rows = np.flatnonzero(score.max(axis=1) >= least)
        if len(rows):
            i, j = np.nonzero(score[rows] >= least[rows, None])
            found.append(rows[i] * width + (j + c * TILE))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _slices(batches, most: int):
    """Parts of about ``most`` rows at most; small batches are put together."""
    held, n = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            held.append(batch.slice(a, most))
            n += held[-1].num_rows
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _merge(top: np.ndarray, ids: np.ndarray, row: np.ndarray, score: np.ndarray, item: np.ndarray) -> None:
    """Puts (row, score, item) into the running lists of k a row, ties by item."""
    k = top.shape[1]
    rows = np.unique(row)
    row = np.concatenate([np.repeat(rows, k), row])
    score, item = np.concatenate([top[rows].ravel(), score]), np.concatenate([ids[rows].ravel(), item])
    order = np.lexsort((item, -score, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, rows)[np.searchsorted(rows, row)]
    kept = place < k
    top[row[kept], place[kept]], ids[row[kept], place[kept]] = score[order][kept], item[order][kept]


def best_and_near(queries: DataFrame, gallery: DataFrame, radius_km: float) -> DataFrame:
    """(qid, top_gid, top, n_near, best_near): the best of the gallery but the query's own id, ties by gid, and count and best score closer than the radius.

    queries(qid, qvec, qlat, qlon) and gallery(gid, gvec, lat, lon).  A task gives one row a query
    that had a pair, whatever it read.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "qvec", "qlat", "qlon")
    items = _dealt(gallery.select(F.col("gid").cast("long").alias("gid"), "gvec", "lat", "lon"))
    most = max(1, QUERY_BYTES // (8 * max(1, _width(queries, "qvec"))))
    n, parts = asked.count(), None
    blocks = max(1, -(-n // (most if n <= most else max(1, most // 2))))
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        shipped = spark.sparkContext.broadcast(mine.toArrow())
        got = items.mapInArrow(lambda batches, shipped=shipped: _best_near(shipped.value, batches, radius_km), "qid long, score double, gid long, n long, near double")
        parts = got if parts is None else parts.union(got)
    best = F.max(F.struct("score", (-F.col("gid")).alias("g"))).alias("m")
    return parts.groupBy("qid").agg(best, F.sum("n").alias("n_near"), F.max("near").alias("best_near")).select("qid", (-F.col("m.g")).alias("top_gid"), F.col("m.score").alias("top"), "n_near", "best_near")


def _best_near(asked: pa.Table, batches, radius_km: float):
    q, qid = _matrix(asked.column("qvec")), asked.column("qid").to_numpy()
    lat, lon = (asked.column(c).to_numpy().astype(np.float64) for c in ("qlat", "qlon"))
    if not len(qid):
        return
    place, near_cos = unit_vectors(lat, lon), math.cos(min(math.pi, radius_km / geo.EARTH_KM))
    top, ids = np.full(len(qid), -np.inf), np.full(len(qid), np.iinfo(np.int64).max)
    n, best, met = np.zeros(len(qid), np.int64), np.full(len(qid), -np.inf), np.zeros(len(qid), bool)
    for part in _slices(batches, ROWS):
        gid, g = part.column("gid").to_numpy(), _matrix(part.column("gvec")).T
        glat, glon = (part.column(c).to_numpy().astype(np.float64) for c in ("lat", "lon"))
        g_place = unit_vectors(glat, glon).T
        by_id = np.argsort(gid, kind="stable")
        for a in range(0, len(qid), ROWS // 2):
            rows = slice(a, a + ROWS // 2)
            score, dot = (q[rows] @ g).round(12), place[rows] @ g_place
            other = qid[rows][:, None] != gid[None, :]
            near = (dot > near_cos) & other
            i, j = np.nonzero(np.abs(dot - near_cos) < 1e-9)  # at the very edge the exact distance decides
            near[i, j] = (haversine_km(lat[a + i], lon[a + i], glat[j], glon[j]) < radius_km) & other[i, j]
            score[~other] = -np.inf
            met[rows] |= other.any(axis=1)
            n[rows] += near.sum(axis=1)
            best[rows] = np.maximum(best[rows], np.where(near, score, -np.inf).max(axis=1))
            at = by_id[score[:, by_id].argmax(axis=1)]  # the first of equal ones by id
            value, item = score[np.arange(len(at)), at], gid[at]
            better = (value > top[rows]) | ((value == top[rows]) & (item < ids[rows]))
            top[rows], ids[rows] = np.where(better, value, top[rows]), np.where(better, item, ids[rows])
    at = np.flatnonzero(met)
    for a in range(0, len(at), 1 << 16):
        x = at[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(qid[x]), pa.array(top[x]), pa.array(ids[x]), pa.array(n[x]), pa.array(best[x], mask=np.isneginf(best[x]))], names=["qid", "score", "gid", "n", "near"])


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def haversine_km(lat: np.ndarray, lon: np.ndarray, rlat: np.ndarray, rlon: np.ndarray) -> np.ndarray:
    a, b, c, d = map(np.radians, (lat, lon, rlat, rlon))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def top_k(pairs: DataFrame, k: int, query: str = "qid", item: str = "gid", score: str = "score") -> DataFrame:
    """Best k a query, ties by item; ``rank`` from 1."""
    by = W.partitionBy(query).orderBy(F.desc(score), item)
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def not_same_author(q: str = "qauthor", g: str = "gauthor") -> Column:
    """Guard: rows of the query's author are out; an unknown author (null) excludes nothing."""
    return F.col(q).isNull() | F.col(g).isNull() | (F.col(q) != F.col(g))


def union_by_rank(lists: DataFrame, keep: int, modalities: tuple[str, ...]) -> DataFrame:
    """(qid, gid, modality, rank, score) to one row a (qid, gid): per modality a normalised rank (1 when not found) and a found flag."""
    aggs = []
    for m in modalities:
        here = F.col("modality") == m
        aggs += [F.coalesce(F.min(F.when(here, (F.col("rank") - 1) / max(keep - 1, 1))), F.lit(1.0)).alias(f"{m}_rank"), F.max(F.when(here, 1).otherwise(0)).cast("long").alias(f"{m}_found"), F.max(F.when(here, F.col("score"))).alias(f"{m}_score")]
    return lists.groupBy("qid", "gid").agg(*aggs)


def union_ordered(lists: DataFrame, capacity: int) -> DataFrame:
    """The union in a total order (best score, best rank, item) cut to a capacity a query."""
    merged = lists.groupBy("qid", "gid").agg(F.max("score").alias("score"), F.min("rank").alias("best_rank"))
    by = W.partitionBy("qid").orderBy(F.desc("score"), "best_rank", "gid")
    return merged.withColumn("place", F.row_number().over(by)).where(F.col("place") <= capacity)


def hubness(knn: DataFrame, n: int = 10) -> DataFrame:
    """Mean similarity of each item's n nearest."""
    return knn.where(F.col("rank") <= n).groupBy("qid").agg(F.avg("score").alias("r"))
