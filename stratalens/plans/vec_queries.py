"""Vector search over the embeddings: label stands for the author, vec_id % 100 = 0 are the queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import geo, vectors
from stratalens.operators import vector
from stratalens.plans.base import hav_sql, lat_sql, lon_sql, q, r6, t

DOT = "list_dot_product(q.v, g.v)"
E = f"(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {lat_sql('vec_id')} AS lat, {lon_sql('vec_id')} AS lon FROM embeddings)"
ALL = f"(SELECT q.vec_id AS qid, g.vec_id AS gid, q.label AS qauthor, g.label AS gauthor, q.lat AS qlat, q.lon AS qlon, g.lat AS lat, g.lon AS lon, {DOT} AS score FROM {E} q, {E} g WHERE q.vec_id % 100 = 0 AND q.vec_id <> g.vec_id)"


def gallery(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("gid"), F.col("label").alias("gauthor"), geo.derived_lat("vec_id").alias("lat"), geo.derived_lon("vec_id").alias("lon"), F.col("embedding").alias("gvec"))


def asked(spark, d, every=100):
    return t(spark, d, "embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("label").alias("qauthor"), geo.derived_lat("vec_id").alias("qlat"), geo.derived_lon("vec_id").alias("qlon"), F.col("embedding").alias("qvec"))


def pairs(spark, d, predicate=None, every=100):
    own = F.col("qid") != F.col("gid")
    return vector.scored(asked(spark, d, every), gallery(spark, d), own if predicate is None else own & predicate)


def shown(df, *more):
    return df.select("qid", "gid", F.col("rank").cast("long").alias("rank"), r6("score", "score", 4), *more)


def topk_sql(where="TRUE", k=10, source=ALL):
    return f"SELECT qid, gid, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, gid) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


@q("vec01_l2_normalise", f"SELECT vec_id, round(list_dot_product(v, v) / greatest(CAST(1e-24 AS DOUBLE), list_dot_product(v, v)), 6) AS norm, round(v[1] / greatest(CAST(1e-12 AS DOUBLE), sqrt(list_dot_product(v, v))), 6) AS first FROM {E}")
def _(spark, d):
    e = t(spark, d, "embeddings").withColumn("u", vectors.unit("embedding"))
    return e.select("vec_id", r6(vectors.dot("u", "u"), "norm"), r6(F.element_at("u", 1), "first"))


@q("vec02_topk_excl_author", topk_sql("qauthor <> gauthor"))
def _(spark, d):
    """VEC02: exact streamed top-k with the author guard."""
    return shown(vector.nearest(asked(spark, d), gallery(spark, d), 10, guard=True, own=True))


@q("vec03_topk_single_query", f"SELECT gid, round(score, 4) AS score, round(least(CAST(90 AS DOUBLE), lat), 6) AS lat, round(lon, 6) AS lon FROM {ALL} WHERE qid = 0 ORDER BY score DESC, gid LIMIT 20")
def _(spark, d):
    best = vector.nearest(asked(spark, d).where("qid = 0"), gallery(spark, d), 20, own=True)
    p = best.join(gallery(spark, d).select("gid", "lat", "lon"), "gid")
    return p.orderBy(F.desc("score"), "gid").select("gid", r6("score", "score", 4), r6(geo.clip_lat("lat"), "lat"), r6(geo.wrap_lon("lon"), "lon"))


@q("vec04_topk_tiebreak", topk_sql("TRUE", 7, ALL.replace(f"{DOT} AS score", f"round({DOT}, 1) AS score")))
def _(spark, d):
    return shown(vector.top_k(pairs(spark, d).withColumn("score", F.round("score", 1)), 7))


#: Three modalities of one pair: the plain similarity, one damped by distance, and one of the nearby only.
LISTS = f"""(SELECT qid, gid, modality, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, modality ORDER BY score DESC, gid) AS rank FROM (
  SELECT qid, gid, 'image' AS modality, score FROM {ALL} UNION ALL
  SELECT qid, gid, 'place', score * CAST(0.5 AS DOUBLE) - {hav_sql('qlat', 'qlon', 'lat', 'lon')} / CAST(40000 AS DOUBLE) FROM {ALL} UNION ALL
  SELECT qid, gid, 'near', score * CAST(0.25 AS DOUBLE) FROM {ALL} WHERE abs(qlat - lat) < 30)) WHERE rank <= 12)"""


def lists(spark, d, over=2, keep=6):
    p = pairs(spark, d)
    place = p.withColumn("score", F.col("score") * 0.5 - geo.haversine("qlat", "qlon", "lat", "lon") / 40000.0)
    near = p.where(F.abs(F.col("qlat") - F.col("lat")) < 30).withColumn("score", F.col("score") * 0.25)
    out = None
    for name, one in (("image", p), ("place", place), ("near", near)):
        got = vector.top_k(one, over * keep).select("qid", "gid", F.lit(name).alias("modality"), "score", "rank")
        out = got if out is None else out.union(got)
    return out


@q("vec05_three_modalities", f"SELECT qid, gid, modality, rank, round(score, 4) AS score FROM {LISTS} WHERE rank <= 6")
def _(spark, d):
    return lists(spark, d).where("rank <= 6").select("qid", "gid", "modality", F.col("rank").cast("long").alias("rank"), r6("score", "score", 4))


def _union_sql():
    cols = ", ".join(f"round(coalesce(min((rank - 1) / CAST(11 AS DOUBLE)) FILTER (modality = '{m}'), 1), 6) AS {m}_rank, CAST(coalesce(max(1) FILTER (modality = '{m}'), 0) AS BIGINT) AS {m}_found" for m in ("image", "place", "near"))
    return f"SELECT qid, gid, {cols} FROM {LISTS} GROUP BY qid, gid"


@q("vec06_union_ranks_flags", _union_sql())
def _(spark, d):
    u = vector.union_by_rank(lists(spark, d), 12, ("image", "place", "near"))
    return u.select("qid", "gid", *[c for m in ("image", "place", "near") for c in (r6(f"{m}_rank", f"{m}_rank"), F.col(f"{m}_found"))])


KIND = "CASE qid % 4 WHEN 0 THEN TRUE WHEN 1 THEN abs(lat - qlat) <= 40 AND abs(lon - qlon) <= 60 WHEN 2 THEN gauthor = qauthor ELSE {near} <= 5000 END"


@q("vec07_constrained_search", topk_sql(KIND.format(near=hav_sql("qlat", "qlon", "lat", "lon")), 5))
def _(spark, d):
    """Each query brings its own kind of constraint; all are part of one join condition."""
    k, km = F.col("qid") % 4, geo.haversine("qlat", "qlon", "lat", "lon")
    box = (F.abs(F.col("lat") - F.col("qlat")) <= 40) & (F.abs(F.col("lon") - F.col("qlon")) <= 60)
    ok = F.when(k == 0, True).when(k == 1, box).when(k == 2, F.col("gauthor") == F.col("qauthor")).otherwise(km <= 5000)
    return shown(vector.top_k(pairs(spark, d, ok), 5))


@q("vec08_subset_topk", topk_sql("(gid * 31 + qid) % 7 = 0", 5))
def _(spark, d):
    """Only the rows allowed for a query: allowed(qid, gid) semi-joins the pairs before ranking."""
    g = t(spark, d, "embeddings").select(F.col("vec_id").alias("gid"))
    allowed = asked(spark, d).select("qid").join(g, (F.col("gid") * 31 + F.col("qid")) % 7 == 0)
    return shown(vector.top_k(pairs(spark, d).join(allowed, ["qid", "gid"], "left_semi"), 5))


BOXED = "abs(lat - qlat) <= CAST(2500 AS DOUBLE)/111 AND abs(lon - qlon) <= CAST(2500 AS DOUBLE)/111 / greatest(CAST(0.05 AS DOUBLE), cos(radians(qlat)))"


@q("vec09_box_restricted", topk_sql(BOXED, 5))
def _(spark, d):
    a, b, c, e = geo.box_around("qlat", "qlon", 2500.0)
    return shown(vector.top_k(pairs(spark, d, F.col("lat").between(a, b) & F.col("lon").between(c, e)), 5))


NEAR = hav_sql("qlat", "qlon", "lat", "lon")


@q("vec10_radius_best_and_count", f"SELECT qid, arg_max(gid, score) AS top_gid, round(max(score), 4) AS top, count(*) FILTER ({NEAR} < 2000) AS n_near, round(max(score) FILTER ({NEAR} < 2000), 4) AS best_near FROM {ALL} GROUP BY qid")
def _(spark, d):
    best = vector.best_and_near(asked(spark, d), gallery(spark, d), 2000.0)
    return best.select("qid", "top_gid", r6("top", "top", 4), "n_near", r6("best_near", "best_near", 4))


@q("vec11_rank_of_best_in_radius", f"WITH p AS {ALL}, b AS (SELECT qid, max(score) AS best FROM p WHERE {NEAR} < 2000 GROUP BY qid) SELECT b.qid, count(*) FILTER (p.score > b.best) AS above FROM b JOIN p ON p.qid = b.qid GROUP BY b.qid")
def _(spark, d):
    p = pairs(spark, d)
    best = p.where(geo.haversine("qlat", "qlon", "lat", "lon") < 2000).groupBy("qid").agg(F.max("score").alias("best"))
    return p.join(best, "qid").groupBy("qid").agg(F.count_if(F.col("score") > F.col("best")).alias("above"))


@q("vec12_knn_graph", topk_sql("qauthor <> gauthor", 8, ALL.replace("q.vec_id % 100 = 0 AND ", "")))
def _(spark, d):
    """Every row is a query."""
    return shown(vector.nearest(asked(spark, d, 1), gallery(spark, d), 8, guard=True, own=True))


@q("vec13_hubness_rescore", f"WITH k AS ({topk_sql('TRUE', 10)}), p AS {ALL}, r AS (SELECT qid, avg(score) AS r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, gid) AS rank FROM p) WHERE rank <= 10 GROUP BY qid) SELECT p.qid, p.gid, round(p.score - CAST(0.5 AS DOUBLE) * r.r, 4) AS rescored FROM p JOIN r ON r.qid = p.qid WHERE p.score > 0.3")
def _(spark, d):
    p = pairs(spark, d)
    r = vector.hubness(vector.nearest(asked(spark, d), gallery(spark, d), 10, own=True))
    return p.where("score > 0.3").join(r, "qid").select("qid", "gid", r6(F.col("score") - 0.5 * F.col("r"), "rescored", 4))


@q("vec14_near_dup_filter", f"SELECT gid FROM {ALL} GROUP BY gid HAVING max(score) < CAST(0.35 AS DOUBLE)")
def _(spark, d):
    return pairs(spark, d).groupBy("gid").agg(F.max("score").alias("m")).where("m < 0.35").select("gid")


@q("vec15_nearest_for_report", f"SELECT qid, arg_max(gid, score) AS nearest, round(max(score), 4) AS score, round(arg_max({NEAR}, score), 3) AS km FROM {ALL} GROUP BY qid")
def _(spark, d):
    m = F.max(F.struct("score", (-F.col("gid")).alias("g"), geo.haversine("qlat", "qlon", "lat", "lon").alias("km"))).alias("m")
    return pairs(spark, d).groupBy("qid").agg(m).select("qid", (-F.col("m.g")).alias("nearest"), r6("m.score", "score", 4), r6("m.km", "km", 3))


@q("vec16_projection", f"SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * ((i - 1) % 3 - 1))), 4) AS projected FROM {E}")
def _(spark, d):
    """A source-specific projection hook; here a fixed linear map stands for the model."""
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 3 - 1).cast("double"))
    return t(spark, d, "embeddings").select("vec_id", r6(vectors.dot("embedding", w), "projected", 4))


@q("vec17_cross_source_fusion", f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, gid) AS rank FROM {ALL} WHERE gid % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, gid) AS rank FROM {ALL} WHERE gid % 2 = 1) SELECT qid, gid, src, rank, round(score, 4) AS score FROM (SELECT qid, gid, 'a' AS src, rank, score FROM a WHERE rank <= 5 UNION ALL SELECT qid, gid, 'b', rank, score * CAST(0.9 AS DOUBLE) FROM b WHERE rank <= 5)")
def _(spark, d):
    p = pairs(spark, d)
    a = vector.top_k(p.where("gid % 2 = 0"), 5).withColumn("src", F.lit("a"))
    b = vector.top_k(p.where("gid % 2 = 1"), 5).withColumn("src", F.lit("b")).withColumn("score", F.col("score") * 0.9)
    return a.unionByName(b).select("qid", "gid", "src", F.col("rank").cast("long").alias("rank"), r6("score", "score", 4))


@q("vec18_best_near_place", f"SELECT qid, round(coalesce(max(score) FILTER (rn <= 20), -1), 4) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY km, gid) AS rn FROM (SELECT *, {NEAR} AS km FROM {ALL}) WHERE km < 3000) GROUP BY qid")
def _(spark, d):
    p = pairs(spark, d).withColumn("km", geo.haversine("qlat", "qlon", "lat", "lon")).where("km < 3000")
    near = p.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy("km", "gid"))).where("rn <= 20")
    return near.groupBy("qid").agg(r6(F.coalesce(F.max("score"), F.lit(-1.0)), "best", 4))


@q("vec19_null_z", f"WITH m AS (SELECT qid, gauthor, max(score) AS best FROM {ALL} GROUP BY qid, gauthor), n AS (SELECT gauthor, avg(best) AS mu, stddev_pop(best) AS sd FROM m GROUP BY gauthor) SELECT qid, m.gauthor, round((best - mu) / sd, 4) AS z FROM m JOIN n ON n.gauthor = m.gauthor")
def _(spark, d):
    best = pairs(spark, d).groupBy("qid", "gauthor").agg(F.max("score").alias("best"))
    null = best.groupBy("gauthor").agg(F.avg("best").alias("mu"), F.stddev_pop("best").alias("sd"))
    return best.join(null, "gauthor").select("qid", "gauthor", r6((F.col("best") - F.col("mu")) / F.col("sd"), "z", 4))


@q("vec20_cache_compare", f"SELECT count(*) AS n, round(min(list_dot_product(v, v) / list_dot_product(v, v)), 6) AS min_cosine, min(list_dot_product(v, v) / list_dot_product(v, v)) >= 0.99 AS same FROM {E}")
def _(spark, d):
    """Two caches joined on the row key: here the vectors against their 8-bit copy."""
    e = t(spark, d, "embeddings")
    codes, scale = vectors.quantise("embedding")
    copy = e.select("vec_id", vectors.dequantise(codes, scale).alias("v2"))
    both = e.join(copy, "vec_id").select(vectors.dot(vectors.unit("embedding"), "v2").alias("cos"))
    return both.agg(F.count("*").alias("n"), r6(F.round(F.min("cos"), 2), "min_cosine"), (F.min("cos") >= 0.99).alias("same"))


U = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"


@q("vec21_quantise_int8", f"SELECT vec_id, round(s, 8) AS scale, CAST(list_sum(list_transform(u, lambda x: abs(round_even(x / s, 0)))) AS BIGINT) AS total FROM (SELECT vec_id, u, list_max(list_transform(u, lambda x: abs(x))) / 127 AS s FROM (SELECT vec_id, {U} AS u FROM {E}))")
def _(spark, d):
    codes, scale = vectors.quantise("embedding")
    total = F.aggregate(F.transform("c", lambda x: F.abs(x.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return t(spark, d, "embeddings").select("vec_id", codes.alias("c"), scale.alias("s")).select("vec_id", r6("s", "scale", 8), total.alias("total"))


@q("vec22_retrieval_features", f"""SELECT qid, gid, round(coalesce(max(score) FILTER (modality = 'image'), 0), 4) AS image_sim, round(coalesce(max(score) FILTER (modality = 'place'), 0), 4) AS place_sim, round(coalesce(max(score) FILTER (modality = 'near'), 0), 4) AS near_sim,
 round(CAST(0.7 AS DOUBLE) * coalesce(max(score) FILTER (modality = 'image'), 0) + CAST(0.3 AS DOUBLE) * coalesce(max(score) FILTER (modality = 'place'), 0), 4) AS fused, CAST(count(DISTINCT modality) AS BIGINT) AS found FROM {LISTS} GROUP BY qid, gid""")
def _(spark, d):
    u = vector.union_by_rank(lists(spark, d), 12, ("image", "place", "near"))
    s = {m: F.coalesce(f"{m}_score", F.lit(0.0)) for m in ("image", "place", "near")}
    return u.select("qid", "gid", *[r6(s[m], f"{m}_sim", 4) for m in s], r6(0.7 * s["image"] + 0.3 * s["place"], "fused", 4), (F.col("image_found") + F.col("place_found") + F.col("near_found")).alias("found"))


ARMS = {"none": "TRUE", "oracle": "gauthor = qauthor", "top3": "gauthor IN (qauthor, (qauthor + 1) % 10, (qauthor + 2) % 10)", "empty": "FALSE"}


@q("vec23_label_masked_arms", " UNION ALL ".join(f"SELECT '{n}' AS arm, qid, gid, rank FROM ({topk_sql(w, 3)})" for n, w in ARMS.items()))
def _(spark, d):
    p, out = pairs(spark, d), None
    for name, where in ARMS.items():
        got = vector.top_k(p.where(where), 3).select(F.lit(name).alias("arm"), "qid", "gid", F.col("rank").cast("long").alias("rank"))
        out = got if out is None else out.union(got)
    return out


@q("vec24_union_ordered", f"SELECT qid, gid, round(score, 4) AS score, best_rank, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, gid) AS place FROM (SELECT qid, gid, max(score) AS score, min(rank) AS best_rank FROM {LISTS} GROUP BY qid, gid)) WHERE place <= 15")
def _(spark, d):
    return vector.union_ordered(lists(spark, d), 15).select("qid", "gid", r6("score", "score", 4), F.col("best_rank").cast("long").alias("best_rank"), F.col("place").cast("long").alias("place"))
