"""Geometry scalars and spatial joins over derived points."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import geo
from stratalens.operators import near, spatial
from stratalens.plans.base import POOL_SQL, hav_sql, lat_sql, lon_sql, points, points_sql, pool, q, r6, t

C, S = points_sql("customer", "c_custkey"), points_sql("supplier", "s_suppkey", "r")


@q("geo01_haversine_km", f"SELECT c_custkey, round({hav_sql('lat', 'lon', 'CAST(48.85 AS DOUBLE)', 'CAST(2.35 AS DOUBLE)')}, 6) AS km FROM {C}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", r6(geo.haversine("lat", "lon", 48.85, 2.35), "km"))


#: Vincenty's inverse formula, a row of the recursion an iteration; points that do not settle get the haversine.
_F = "(CAST(1 AS DOUBLE) / CAST(298.257223563 AS DOUBLE))"
GEODESIC = f"""WITH RECURSIVE u AS (SELECT c_custkey, lat, lon, atan((1 - {_F}) * tan(radians(lat))) AS u1, atan((1 - {_F}) * tan(radians(CAST(48.85 AS DOUBLE)))) AS u2, radians(CAST(2.35 AS DOUBLE)) - radians(lon) AS step FROM {C}),
v(c_custkey, k, lam, moved) AS (SELECT c_custkey, 0, step, CAST(1 AS DOUBLE) FROM u
 UNION ALL SELECT c_custkey, k + 1, new, abs(new - lam) FROM (SELECT *, step + (1 - kk) * {_F} * al * (sigma + kk * s * (mid + kk * c * (2 * mid * mid - 1))) AS new FROM (SELECT *, {_F} / 16 * cos2 * (4 + {_F} * (4 - 3 * cos2)) AS kk FROM (SELECT *, CASE WHEN cos2 > 1e-15 THEN c - 2 * sin(u1) * sin(u2) / cos2 ELSE 0 END AS mid FROM (SELECT *, 1 - al * al AS cos2 FROM (SELECT *, atan2(s, c) AS sigma, CASE WHEN s > 0 THEN cos(u1) * cos(u2) * sin(lam) / s ELSE 0 END AS al FROM (SELECT v.c_custkey, v.k, v.lam, u.u1, u.u2, u.step, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS c FROM v JOIN u USING (c_custkey) WHERE v.k < 60 AND v.moved >= 1e-12))))))),
last AS (SELECT c_custkey, arg_max(lam, k) AS lam, arg_max(moved, k) AS moved FROM v GROUP BY 1),
w AS (SELECT *, atan2(s, c) AS sigma, CASE WHEN s > 0 THEN cos(u1) * cos(u2) * sin(lam) / s ELSE 0 END AS al FROM (SELECT u.*, last.lam, last.moved, sqrt(pow(cos(u2) * sin(last.lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(last.lam), 2)) AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(last.lam) AS c FROM last JOIN u USING (c_custkey))),
y AS (SELECT *, CASE WHEN 1 - al * al > 1e-15 THEN c - 2 * sin(u1) * sin(u2) / (1 - al * al) ELSE 0 END AS mid, CAST(6378.137 AS DOUBLE) * (1 - {_F}) AS b, (1 - al * al) * (1 / pow(1 - {_F}, 2) - 1) AS w2 FROM w),
z AS (SELECT *, 1 + w2 / 16384 * (4096 + w2 * (-768 + w2 * (320 - 175 * w2))) AS big, w2 / 1024 * (256 + w2 * (-128 + w2 * (74 - 47 * w2))) AS small FROM y)
SELECT c_custkey, round(CASE WHEN moved < 1e-12 THEN b * big * (sigma - small * s * (mid + small / 4 * (c * (2 * mid * mid - 1) - small / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)))) ELSE {hav_sql('lat', 'lon', 'CAST(48.85 AS DOUBLE)', 'CAST(2.35 AS DOUBLE)')} END, 5) AS km FROM z"""


@q("geo02_geodesic_km", GEODESIC)
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", r6(geo.geodesic("lat", "lon", F.lit(48.85), F.lit(2.35)), "km", 5))


@q("geo03_unit_xyz", f"SELECT c_custkey, round(cos(radians(lat)) * cos(radians(lon)), 9) AS x, round(cos(radians(lat)) * sin(radians(lon)), 9) AS y, round(sin(radians(lat)), 9) AS z, round(2 * CAST(6371 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt(pow(1 - cos(radians(lat)) * cos(radians(lon)), 2) + pow(cos(radians(lat)) * sin(radians(lon)), 2) + pow(sin(radians(lat)), 2)) / 2)), 4) AS km FROM {C}")
def _(spark, d):
    x, y, z = geo.unit_xyz("lat", "lon")
    chord = F.sqrt(F.pow(1 - x, 2) + F.pow(y, 2) + F.pow(z, 2))
    return points(spark, d, "customer", "c_custkey").select("c_custkey", r6(x, "x", 9), r6(y, "y", 9), r6(z, "z", 9), r6(geo.chord_to_km(chord), "km", 4))


@q("geo04_wrap_clip", f"SELECT c_custkey, round(greatest(CAST(-90 AS DOUBLE), least(CAST(90 AS DOUBLE), lat * CAST(1.5 AS DOUBLE))), 6) AS lat, round((((lon * 3 + 180) % 360) + 360) % 360 - 180, 6) AS lon FROM {C}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", r6(geo.clip_lat(F.col("lat") * 1.5), "lat"), r6(geo.wrap_lon(F.col("lon") * 3), "lon"))


@q("geo05_box_around", f"SELECT c_custkey, round(lat - CAST(25 AS DOUBLE)/111, 6) AS lat_min, round(lat + CAST(25 AS DOUBLE)/111, 6) AS lat_max, round(lon - CAST(25 AS DOUBLE)/111 / greatest(CAST(0.05 AS DOUBLE), cos(radians(lat))), 6) AS lon_min, round(lon + CAST(25 AS DOUBLE)/111 / greatest(CAST(0.05 AS DOUBLE), cos(radians(lat))), 6) AS lon_max FROM {C}")
def _(spark, d):
    box = geo.box_around("lat", "lon", 25.0)
    return points(spark, d, "customer", "c_custkey").select("c_custkey", *[r6(c, n) for c, n in zip(box, ("lat_min", "lat_max", "lon_min", "lon_max"), strict=True)])


@q("geo06_cell_id", f"SELECT c_custkey, CAST(floor((lat + 90) / CAST(0.5 AS DOUBLE)) AS INTEGER) AS r, CAST(floor((lon + 180) / CAST(0.5 AS DOUBLE)) AS INTEGER) AS c FROM {C}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", geo.cell("lat", 0.5, -90.0).alias("r"), geo.cell("lon", 0.5, -180.0).alias("c"))


@q("geo07_point_to_box", f"SELECT c_custkey, round({hav_sql('lat', 'lon', 'least(greatest(lat, CAST(-20 AS DOUBLE)), CAST(30 AS DOUBLE))', 'least(greatest(lon, CAST(10 AS DOUBLE)), CAST(60 AS DOUBLE))')}, 6) AS km FROM {C}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", r6(geo.box_km("lat", "lon", -20.0, 30.0, 10.0, 60.0), "km"))


P_BOX = f"(SELECT p_partkey, p_type, p_size, {lat_sql('p_partkey')} - CAST(p_size AS DOUBLE)/40 AS lat_min, {lat_sql('p_partkey')} + CAST(p_size AS DOUBLE)/40 AS lat_max, {lon_sql('p_partkey')} - CAST(p_size AS DOUBLE)/20 AS lon_min, {lon_sql('p_partkey')} + CAST(p_size AS DOUBLE)/20 AS lon_max FROM part)"


def boxes(spark, d, prefix=""):
    a, b, s = geo.derived_lat("p_partkey"), geo.derived_lon("p_partkey"), F.col("p_size").cast("double")
    return t(spark, d, "part").select("p_partkey", "p_type", "p_size", (a - s / 40).alias(f"{prefix}lat_min"), (a + s / 40).alias(f"{prefix}lat_max"), (b - s / 20).alias(f"{prefix}lon_min"), (b + s / 20).alias(f"{prefix}lon_max"))


@q("geo08_half_diagonal", f"SELECT p_partkey, round(sqrt(pow((lat_max - lat_min)/2, 2) + pow((lon_max - lon_min)/2 * cos(radians((lat_min + lat_max)/2)), 2)) * CAST(111.2 AS DOUBLE), 6) AS km FROM {P_BOX}")
def _(spark, d):
    return boxes(spark, d).select("p_partkey", r6(geo.half_diagonal_km("lat_min", "lat_max", "lon_min", "lon_max"), "km"))


@q("geo09_pairwise_km", f"SELECT a.qid, a.pos AS a, b.pos AS b, round({hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km FROM {POOL_SQL} a JOIN {POOL_SQL} b ON a.qid = b.qid AND a.pos < b.pos")
def _(spark, d):
    """The matrix of each query's candidates, a short list."""
    p = pool(spark, d)
    b = p.select("qid", F.col("pos").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(b, "qid").where("pos < b").select("qid", F.col("pos").alias("a"), "b", r6(geo.haversine("lat", "lon", "lat2", "lon2"), "km"))


def _ring(spark, d, n=40):
    """Rectangles with a hole, one a nation, as rings of points."""
    k = F.col("n_nationkey")
    lat, lon, half = (k % 5 * 30 - 60).cast("double"), (F.floor(k / 5) * 60 - 150).cast("double"), (k % 7 + 3).cast("double")

    def ring(h):
        corner = lambda a, b: F.struct((lat + a * h).alias("lat"), (lon + b * h).alias("lon"))
        return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1))

    return t(spark, d, "nation").select("n_nationkey", "n_regionkey", F.array(ring(half), ring(half / 4)).alias("rings"), (lat - half).alias("lat_min"), (lat + half).alias("lat_max"), (lon - half).alias("lon_min"), (lon + half).alias("lon_max"), half.alias("half"))


N_RING = "(SELECT n_nationkey, n_regionkey, CAST(n_nationkey % 5 * 30 - 60 AS DOUBLE) AS clat, CAST(floor(n_nationkey / 5) * 60 - 150 AS DOUBLE) AS clon, CAST(n_nationkey % 7 + 3 AS DOUBLE) AS half FROM nation)"


@q("geo10_polygon_km2", f"SELECT n_nationkey, round((radians(2 * half) * (sin(radians(clat + half)) - sin(radians(clat - half))) - radians(half / 2) * (sin(radians(clat + half / 4)) - sin(radians(clat - half / 4)))) * pow(CAST(6371.0072 AS DOUBLE), 2), 2) AS km2 FROM {N_RING}")
def _(spark, d):
    return _ring(spark, d).select("n_nationkey", r6(spatial.polygon_km2(F.col("rings")), "km2", 2))


@q("geo11_dms_decimal", "SELECT c_custkey, round((CAST(c_custkey % 90 AS DOUBLE) + CAST(c_custkey % 60 AS DOUBLE)/60 + CAST(c_custkey % 59 AS DOUBLE)/3600) * (CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END), 9) AS decimal_deg FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    part = lambda m: (k % m).cast("double")
    return t(spark, d, "customer").select("c_custkey", r6(geo.dms(part(90), part(60), part(59), F.when(k % 2 == 0, "s").otherwise("N")), "decimal_deg", 9))


@q("geo12_score_5000", f"SELECT c_custkey, round_even(5000 * exp(-{hav_sql('lat', 'lon', '0', '0')} / CAST(1492.7 AS DOUBLE)), 0) AS score FROM {C}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", geo.score_5000(geo.haversine("lat", "lon", 0.0, 0.0)).alias("score"))


@q("geo13_tiles", f"SELECT c_custkey, x, y, round(degrees(atan(sinh(pi() * (1 - 2 * (y + CAST(0.5 AS DOUBLE)) / 16384)))), 6) AS lat, round((x + CAST(0.5 AS DOUBLE)) / 16384 * 360 - 180, 6) AS lon FROM (SELECT c_custkey, CAST(floor((lon + 180) / 360 * 16384) AS INTEGER) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384) AS INTEGER) AS y FROM {C})")
def _(spark, d):
    x, y = geo.tile("lat", "lon", 14)
    a, b = geo.tile_point("x", "y", 14, 0.5, 0.5, 1.0)
    return points(spark, d, "customer", "c_custkey").select("c_custkey", x.alias("x"), y.alias("y")).select("c_custkey", "x", "y", r6(a, "lat"), r6(b, "lon"))


@q("geo14_invalid_null", f"SELECT c_custkey, CASE WHEN lat * 2 BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN 'ok' ELSE '' END AS label FROM {C}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", F.when(geo.valid(F.col("lat") * 2, "lon"), "ok").otherwise("").alias("label"))


# -- spatial joins -------------------------------------------------------------------------------

PAIRS = f"(SELECT c_custkey, s_suppkey, {hav_sql('lat', 'lon', 'rlat', 'rlon')} AS km FROM {C}, {S})"


def pairs(spark, d, km):
    c, s = points(spark, d, "customer", "c_custkey"), points(spark, d, "supplier", "s_suppkey", "r")
    return spatial.radius_join(c, s, km, spread=spatial.spread_of(c, s))


@q("spj01_radius_join", f"SELECT c_custkey, s_suppkey, round(km, 6) AS km FROM {PAIRS} WHERE km <= 1500")
def _(spark, d):
    return pairs(spark, d, 1500.0).select("c_custkey", "s_suppkey", r6("km", "km"))


@q("spj02_knn_in_radius", f"SELECT c_custkey, s_suppkey, round(km, 6) AS km, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rank FROM {PAIRS} WHERE km <= 2500) WHERE rank <= 3")
def _(spark, d):
    got = near.k_nearest(points(spark, d, "customer", "c_custkey"), points(spark, d, "supplier", "s_suppkey", "r"), "c_custkey", "s_suppkey", 2500.0, 3)
    return got.select("c_custkey", "s_suppkey", r6("km", "km"), F.col("rank").cast("long").alias("rank"))


@q("spj03_nearest", f"SELECT c_custkey, s_suppkey, round(km, 6) AS km, CASE WHEN km > 30 THEN 'near ' ELSE '' END || 'S' || s_suppkey AS label FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rank FROM {PAIRS}) WHERE rank = 1")
def _(spark, d):
    got = spatial.nearest_ring(points(spark, d, "customer", "c_custkey"), points(spark, d, "supplier", "s_suppkey", "r"), "c_custkey", "s_suppkey")
    return got.select("c_custkey", "s_suppkey", r6("km", "km"), F.concat(F.when(F.col("km") > 30, "near ").otherwise(""), F.lit("S"), F.col("s_suppkey").cast("string")).alias("label"))


RINGS = (0, 4, 12)


@q("spj04_town_ring_label", f"""WITH p AS (SELECT c_custkey, s_suppkey, km, greatest(abs(floor(lat) - floor(rlat)), abs(floor(lon) - floor(rlon))) AS far FROM (SELECT c.*, s.*, {hav_sql('lat', 'lon', 'rlat', 'rlon')} AS km FROM {C} c, {S} s)),
r AS (SELECT *, CASE WHEN far <= 0 THEN 0 WHEN far <= 4 THEN 1 WHEN far <= 12 THEN 2 END AS ring FROM p WHERE far <= 12)
SELECT c_custkey, s_suppkey, CAST(ring AS INTEGER) AS ring FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY ring, km, s_suppkey) AS rn FROM r) WHERE rn = 1""")
def _(spark, d):
    """The nearest town in the first non-empty ring of 1-degree cells."""
    c, s = points(spark, d, "customer", "c_custkey"), points(spark, d, "supplier", "s_suppkey", "r").withColumn("cr", F.floor("rlat")).withColumn("cc", F.floor("rlon"))
    todo, out = c, None
    for i, ring in enumerate(RINGS):
        steps = F.sequence(F.lit(-ring), F.lit(ring))
        around = todo.withColumn("cr", F.explode(F.transform(steps, lambda x: F.floor("lat") + x))).withColumn("cc", F.explode(F.transform(steps, lambda x: F.floor("lon") + x)))
        near = around.join(s, ["cr", "cc"]).withColumn("rn", F.row_number().over(W.partitionBy("c_custkey").orderBy(geo.haversine("lat", "lon", "rlat", "rlon"), "s_suppkey"))).where("rn = 1").select("c_custkey", "s_suppkey", F.lit(i).alias("ring"))
        out = near if out is None else out.union(near)
        todo = todo.join(near.select("c_custkey"), "c_custkey", "left_anti")
    return out


@q("spj05_big_town_window", f"SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS rn FROM (SELECT c.*, s.s_suppkey, s.rlat, s.rlon, {hav_sql('lat', 'lon', 'rlat', 'rlon')} AS km FROM {C} c, {points_sql('supplier', 's_suppkey', 'r', 's_acctbal')} s WHERE s_acctbal >= 5000 AND abs(lat - rlat) <= 10 AND abs(lon - rlon) <= 15)) WHERE rn = 1")
def _(spark, d):
    """The nearest large town in a window of latitude and longitude."""
    s = points(spark, d, "supplier", "s_suppkey", "r", "s_acctbal").where("s_acctbal >= 5000")
    window = (F.abs(F.col("lat") - F.col("rlat")) <= 10) & (F.abs(F.col("lon") - F.col("rlon")) <= 15)
    # No place of the window is farther than 10 degrees along a meridian and 15 along a parallel.
    got = spatial.nearest(points(spark, d, "customer", "c_custkey"), s, "c_custkey", "s_suppkey", 2800.0, 1, window)
    return got.select("c_custkey", "s_suppkey")


@q("spj06_grid_neighbour_scan", f"SELECT c_custkey, count(*) AS n FROM {PAIRS} WHERE km <= 800 GROUP BY c_custkey")
def _(spark, d):
    return pairs(spark, d, 800.0).groupBy("c_custkey").agg(F.count("*").alias("n"))


@q("spj07_latitude_band", f"SELECT s_suppkey, round({hav_sql('rlat', 'rlon', '10', '20')}, 6) AS km FROM {S} WHERE rlat BETWEEN 10 - CAST(3000 AS DOUBLE)/111 AND 10 + CAST(3000 AS DOUBLE)/111 AND {hav_sql('rlat', 'rlon', '10', '20')} <= 3000")
def _(spark, d):
    s, half = points(spark, d, "supplier", "s_suppkey", "r"), 3000.0 / 111
    km = geo.haversine("rlat", "rlon", 10.0, 20.0)
    return s.where(F.col("rlat").between(10 - half, 10 + half)).where(km <= 3000).select("s_suppkey", r6(km, "km"))


BOX_PAIR = f"(SELECT c_custkey, p_partkey, p_type, {hav_sql('lat', 'lon', 'least(greatest(lat, lat_min), lat_max)', 'least(greatest(lon, lon_min), lon_max)')} AS km FROM {C}, {P_BOX})"


def box_pairs(spark, d, km):
    c = points(spark, d, "customer", "c_custkey")
    return spatial.boxes_near(c, boxes(spark, d), km, (60.0, 200.0))


@q("spj08_point_to_box_km", f"SELECT c_custkey, p_partkey, round(km, 6) AS km FROM {BOX_PAIR} WHERE km <= 300")
def _(spark, d):
    return box_pairs(spark, d, 300.0).select("c_custkey", "p_partkey", r6("km", "km"))


@q("spj09_box_nearest_by_word", f"SELECT c_custkey, p_type AS word, count(*) AS n, round(min(km), 6) AS nearest_km FROM {BOX_PAIR} WHERE km <= 500 GROUP BY ALL")
def _(spark, d):
    return box_pairs(spark, d, 500.0).groupBy("c_custkey", F.col("p_type").alias("word")).agg(F.count("*").alias("n"), r6(F.min("km"), "nearest_km"))


@q("spj10_box_overlap", f"SELECT a.p_partkey AS a, b.p_partkey AS b FROM {P_BOX} a JOIN {P_BOX} b ON a.p_partkey < b.p_partkey AND a.lat_min <= b.lat_max AND b.lat_min <= a.lat_max AND a.lon_min <= b.lon_max AND b.lon_min <= a.lon_max")
def _(spark, d):
    left = boxes(spark, d).withColumnRenamed("p_partkey", "a").drop("p_type", "p_size")
    right = boxes(spark, d, "r").withColumnRenamed("p_partkey", "b").drop("p_type", "p_size")
    return spatial.box_overlap(left, right).where("a < b").select("a", "b")


DENSITY = f"""WITH g AS (SELECT CAST(floor((rlat + 90) / 5) AS INTEGER) AS r, CAST(floor((rlon + 180) / 5) AS INTEGER) % 72 AS c, count(*) AS n FROM {S} GROUP BY ALL),
p AS (SELECT c_custkey, CAST(floor((lat + 90) / 5) AS INTEGER) AS r, CAST(floor((lon + 180) / 5) AS INTEGER) AS c FROM {C})
SELECT c_custkey, CAST(coalesce(sum(n), 0) AS BIGINT) AS density FROM p LEFT JOIN g ON abs(p.r - g.r) <= 2 AND least((p.c - g.c + 72) % 72, (g.c - p.c + 72) % 72) <= 2 GROUP BY c_custkey"""


@q("spj11_cell_density", DENSITY)
def _(spark, d):
    return spatial.cell_density(points(spark, d, "customer", "c_custkey"), points(spark, d, "supplier", "s_suppkey"), "c_custkey", 5.0, 2)


@q("spj12_box_density_prefix_sum", f"""WITH g AS (SELECT CAST(floor((rlat + 90) / 5) AS INTEGER) AS r, CAST(floor((rlon + 180) / 5) AS INTEGER) AS c FROM {S})
SELECT n_nationkey, (SELECT count(*) FROM g WHERE g.r BETWEEN n_nationkey % 20 + 5 AND n_nationkey % 20 + 15 AND g.c BETWEEN n_nationkey AND n_nationkey + 25) AS density FROM nation""")
def _(spark, d):
    """Counts in cell boxes from a summed-area table: two running sums, then four corners a box."""
    g = points(spark, d, "supplier", "s_suppkey").groupBy(geo.cell("lat", 5.0, -90.0).alias("r"), geo.cell("lon", 5.0, -180.0).alias("c")).agg(F.count("*").alias("n"))
    full = spark.range(36 * 72).select((F.col("id") / 72).cast("int").alias("r"), (F.col("id") % 72).cast("int").alias("c")).join(g, ["r", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    up = full.withColumn("n", F.sum("n").over(W.partitionBy("c").orderBy("r")))
    area = up.withColumn("n", F.sum("n").over(W.partitionBy("r").orderBy("c")))
    k = F.col("n_nationkey")
    corners = F.array(*[F.struct((k % 20 + a).alias("r"), (k + b).alias("c"), F.lit(s).alias("s")) for a, b, s in ((15, 25, 1), (4, 25, -1), (15, -1, -1), (4, -1, 1))])
    asked = t(spark, d, "nation").select("n_nationkey", F.explode(corners).alias("x")).select("n_nationkey", "x.*")
    return asked.join(area, ["r", "c"], "left").groupBy("n_nationkey").agg(F.coalesce(F.sum(F.col("s") * F.col("n")), F.lit(0)).alias("density"))


@q("spj13_self_pairs_cosine", f"""WITH e AS (SELECT vec_id, label, embedding, {lat_sql('vec_id')} AS lat, {lon_sql('vec_id')} AS lon FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS sim FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.label <> b.label AND {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500 WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.1""")
def _(spark, d):
    from stratalens.functions import vectors

    a = points(spark, d, "embeddings", "vec_id", "", "label", "embedding")
    b = a.select(F.col("vec_id").alias("b"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.col("label").alias("blabel"), F.col("embedding").alias("bvec"))
    near = spatial.radius_join(a, b, 500.0).where("vec_id < b and label <> blabel").withColumn("sim", vectors.dot("embedding", "bvec"))
    return near.where("sim > 0.1").select(F.col("vec_id").alias("a"), "b", r6("sim", "sim", 4))


INSIDE = f"(SELECT c_custkey, n_nationkey, n_regionkey, half FROM {C}, {N_RING} WHERE abs(lat - clat) <= half AND abs(lon - clon) <= half AND NOT (abs(lat - clat) < half / 4 AND abs(lon - clon) < half / 4))"


def inside(spark, d):
    return spatial.in_polygon(points(spark, d, "customer", "c_custkey"), _ring(spark, d))


@q("spj14_point_in_polygon", f"SELECT c_custkey, arg_min(n_nationkey, half * 1000 + n_nationkey) AS smallest, count(*) AS n FROM {INSIDE} GROUP BY c_custkey")
def _(spark, d):
    return inside(spark, d).groupBy("c_custkey").agg(F.min(F.struct("half", "n_nationkey")).alias("m"), F.count("*").alias("n")).select("c_custkey", F.col("m.n_nationkey").alias("smallest"), "n")


@q("spj15_admin_chain", f"""WITH i AS {INSIDE}, finest AS (SELECT c_custkey, arg_min(n_nationkey, half * 1000 + n_nationkey) AS fine FROM i GROUP BY 1), biggest AS (SELECT c_custkey, arg_max(n_nationkey, half * 1000 - n_nationkey) AS city FROM i GROUP BY 1)
SELECT c.c_custkey, coalesce('N' || fine, '') AS fine, coalesce(n.n_name, h.n_name) AS city, r.r_name AS region FROM customer c LEFT JOIN finest USING (c_custkey) LEFT JOIN biggest USING (c_custkey) LEFT JOIN nation n ON n.n_nationkey = city LEFT JOIN nation h ON h.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = coalesce(n.n_regionkey, h.n_regionkey)""")
def _(spark, d):
    """A canonical chain per point: the finest area, the largest as city, fallbacks through the hierarchy."""
    i = inside(spark, d)
    fine = i.groupBy("c_custkey").agg(F.min(F.struct("half", "n_nationkey")).alias("f"), F.max(F.struct("half", (-F.col("n_nationkey")).alias("k"))).alias("m"))
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    a = n.select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("cn"), F.col("n_regionkey").alias("cr"))
    h = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("hn"), F.col("n_regionkey").alias("hr"))
    c = t(spark, d, "customer").join(fine, "c_custkey", "left").withColumn("ck", -F.col("m.k"))
    out = c.join(F.broadcast(a), "ck", "left").join(F.broadcast(h), "c_nationkey", "left").withColumn("r_regionkey", F.coalesce("cr", "hr")).join(F.broadcast(r), "r_regionkey", "left")
    return out.select("c_custkey", F.coalesce(F.concat(F.lit("N"), F.col("f.n_nationkey").cast("string")), F.lit("")).alias("fine"), F.coalesce("cn", "hn").alias("city"), F.col("r_name").alias("region"))


def _grid_sql(size):
    return f"(SELECT r, c, arg_min(lab, -n * 1000 + ord) AS found FROM (SELECT CAST(floor((lat + 90) / CAST({size} AS DOUBLE)) AS INTEGER) AS r, CAST(floor((lon + 180) / CAST({size} AS DOUBLE)) AS INTEGER) AS c, c_mktsegment AS lab, count(*) AS n, ascii(c_mktsegment) AS ord FROM {points_sql('customer', 'c_custkey', '', 'c_mktsegment')} GROUP BY ALL) GROUP BY r, c)"


@q("spj16_label_grid_fallback", "SELECT s_suppkey, coalesce(a.found, b.found, e.found) AS found FROM " + S + " s " + " ".join(f"LEFT JOIN {_grid_sql(z)} {n} ON {n}.r = CAST(floor((s.rlat + 90) / CAST({z} AS DOUBLE)) AS INTEGER) AND {n}.c = CAST(floor((s.rlon + 180) / CAST({z} AS DOUBLE)) AS INTEGER)" for z, n in ((1, "a"), (4, "b"), (15, "e"))))
def _(spark, d):
    got = spatial.label_with_fallback(points(spark, d, "supplier", "s_suppkey"), points(spark, d, "customer", "c_custkey", "", "c_mktsegment"), "c_mktsegment", (1.0, 4.0, 15.0))
    return got.select("s_suppkey", "found")


@q("spj17_candidates_in_areas", f"SELECT s_suppkey, count(*) FILTER (km < 300) > 0 AS any_in, round(coalesce(sum(bal) FILTER (km < 300), 0), 4) AS mass FROM (SELECT s_suppkey, c.c_acctbal AS bal, {hav_sql('lat', 'lon', 'rlat', 'rlon')} AS km FROM {S}, {points_sql('customer', 'c_custkey', '', 'c_acctbal')} c) GROUP BY s_suppkey")
def _(spark, d):
    s = points(spark, d, "supplier", "s_suppkey", "r")
    c = points(spark, d, "customer", "c_custkey", "", "c_acctbal")
    mass = spatial.radius_join(c, s, 300.0, strict=True).groupBy("s_suppkey").agg(F.sum("c_acctbal").alias("mass"))
    return s.join(mass, "s_suppkey", "left").select("s_suppkey", F.col("mass").isNotNull().alias("any_in"), r6(F.coalesce("mass", F.lit(0.0)), "mass", 4))


RASTER = "(SELECT p_partkey, rlat, rlon, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value FROM " + points_sql("part", "p_partkey", "r", "p_size") + ")"


@q("spj18_zonal_stats", f"SELECT s_suppkey, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, count(*) AS n FROM (SELECT s.s_suppkey, g.value, {hav_sql('s.lat', 's.lon', 'g.rlat', 'g.rlon')} AS km FROM {points_sql('supplier', 's_suppkey')} s, {RASTER} g WHERE g.value IS NOT NULL) WHERE km <= 900 GROUP BY s_suppkey")
def _(spark, d):
    raster = points(spark, d, "part", "p_partkey", "r", "p_size").select("p_partkey", "rlat", "rlon", F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).alias("value"))
    got = spatial.disc_stats(points(spark, d, "supplier", "s_suppkey"), raster, "s_suppkey", 900.0)
    return got.select("s_suppkey", r6("mean", "mean"), r6("variance", "variance"), "n")


@q("spj19_count_within", f"SELECT c_custkey, count(*) FILTER (km <= 1000) AS n FROM {PAIRS} GROUP BY c_custkey")
def _(spark, d):
    c = points(spark, d, "customer", "c_custkey")
    n = pairs(spark, d, 1000.0).groupBy("c_custkey").agg(F.count("*").alias("n"))
    return c.join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@q("spj20_support_k_nearest", f"SELECT c_custkey, rank, s_suppkey, round(km, 6) AS km FROM (SELECT c.c_custkey, p.s_suppkey, p.km, row_number() OVER (PARTITION BY c.c_custkey ORDER BY p.km NULLS LAST, p.s_suppkey) AS rank FROM customer c LEFT JOIN (SELECT * FROM {PAIRS} WHERE km <= 700) p USING (c_custkey)) WHERE rank <= 4")
def _(spark, d):
    c, s = points(spark, d, "customer", "c_custkey"), points(spark, d, "supplier", "s_suppkey", "r")
    found = near.k_nearest(c, s, "c_custkey", "s_suppkey", 700.0, 4).select("c_custkey", "s_suppkey", "km", "rank")
    return c.select("c_custkey").join(found, "c_custkey", "left").select("c_custkey", F.coalesce("rank", F.lit(1)).cast("long").alias("rank"), "s_suppkey", r6("km", "km"))


@q("spj21_evidence_counts", f"SELECT c_custkey, count(*) FILTER (km <= 500) AS near_n, round(max(s_acctbal) FILTER (km <= 500), 2) AS best, count(*) FILTER (km <= 500 AND s_acctbal > 5000) AS hits FROM (SELECT c_custkey, s_acctbal, {hav_sql('lat', 'lon', 'rlat', 'rlon')} AS km FROM {C}, {points_sql('supplier', 's_suppkey', 'r', 's_acctbal')}) GROUP BY c_custkey")
def _(spark, d):
    c, s = points(spark, d, "customer", "c_custkey"), points(spark, d, "supplier", "s_suppkey", "r", "s_acctbal")
    near = spatial.radius_join(c, s, 500.0).groupBy("c_custkey").agg(F.count("*").alias("near_n"), r6(F.max("s_acctbal"), "best", 2), F.count_if(F.col("s_acctbal") > 5000).alias("hits"))
    return c.select("c_custkey").join(near, "c_custkey", "left").fillna(0, ["near_n", "hits"])


TILE = "CAST(floor(({lon} + 180) / 360 * 16) AS INTEGER) AS tx, CAST(floor((1 - asinh(tan(radians({lat}))) / pi()) / 2 * 16) AS INTEGER) AS ty"


@q("spj22_tile_cover", f"SELECT c_custkey, s_suppkey FROM {PAIRS} WHERE km <= 1200")
def _(spark, d):
    """Tiles that a radius can touch are listed for each supplier, the smaller side, and joined on tile, then the radius decides."""
    radius, zoom = 1200.0, 6
    n = 1 << zoom
    s = points(spark, d, "supplier", "s_suppkey", "r")
    reach = radius / geo.EARTH_KM * 180 / math.pi * 1.005
    top, low = F.least(F.lit(89.0), F.col("rlat") + reach), F.greatest(F.lit(-89.0), F.col("rlat") - reach)
    far = F.abs(F.col("rlat")) + reach
    span = F.when(far < 89, F.least(F.lit(180.0), reach / F.cos(F.radians(far)))).otherwise(180.0)
    row = lambda lat: F.greatest(F.lit(0), F.least(F.lit(n - 1), geo.tile(lat, "rlon", zoom)[1]))
    x0, x1 = geo.tile("rlat", F.col("rlon") - span, zoom)[0], geo.tile("rlat", F.col("rlon") + span, zoom)[0]
    cover = s.withColumn("ty", F.explode(F.sequence(row(top), row(low)))).withColumn("tx", F.explode(F.array_distinct(F.transform(F.sequence(x0, F.least(x1, x0 + n - 1)), lambda x: F.pmod(x, F.lit(n))))))
    x, y = geo.tile("lat", "lon", zoom)
    c = points(spark, d, "customer", "c_custkey").withColumn("tx", F.pmod(x, F.lit(n))).withColumn("ty", F.greatest(F.lit(0), F.least(F.lit(n - 1), y)))
    cover, c, near = spatial.by_vectors(cover, c, geo.haversine("lat", "lon", "rlat", "rlon") <= radius, radius / geo.EARTH_KM, "r", "")
    return cover.hint("merge").join(c, ["tx", "ty"]).where(near).select("c_custkey", "s_suppkey")


@q("spj23_nearest_and_counts", f"SELECT c_custkey, round(coalesce(min(km) FILTER (km <= 1000), 99), 6) AS nearest_km, count(*) FILTER (km <= 250) AS n250, count(*) FILTER (km <= 500) AS n500, count(*) FILTER (km <= 1000) AS n1000 FROM {PAIRS} GROUP BY c_custkey")
def _(spark, d):
    c = points(spark, d, "customer", "c_custkey")
    near = pairs(spark, d, 1000.0).groupBy("c_custkey").agg(F.min("km").alias("m"), *[F.count_if(F.col("km") <= k).alias(f"n{k}") for k in (250, 500, 1000)])
    return c.select("c_custkey").join(near, "c_custkey", "left").select("c_custkey", r6(F.coalesce("m", F.lit(99.0)), "nearest_km"), *[F.coalesce(f"n{k}", F.lit(0)).alias(f"n{k}") for k in (250, 500, 1000)])
