"""Spatial joins by cells: both sides get cell keys, an equi-join pairs them, exact distance decides.

A distance predicate alone would be a nested loop.  Points of the right side have one cell; a left
point is repeated for the cells that its radius can reach (rows by latitude, columns by the
cosine at the far edge, wrapping at the antimeridian).  The equi-join shuffles on cells, and
adaptive execution splits crowded ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import geo
from stratalens.sources.shared import written


def cell_size(radius_km: float) -> float:
    """Degrees, so that a radius spans about one cell and whole cells go round the globe (columns wrap exactly)."""
    return 360.0 / math.floor(360 / min(30.0, max(0.05, radius_km / geo.KM_PER_DEGREE)))


def with_cell(points: DataFrame, size: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    columns = round(360 / size)
    return points.withColumn("__row", F.floor((F.col(lat) + 90) / size).cast("int")).withColumn("__col", F.pmod(F.floor((F.col(lon) + 180) / size), F.lit(columns)).cast("int"))


def with_reach(points: DataFrame, radius_km: float, size: float, lat: str = "lat", lon: str = "lon", earth: float = geo.EARTH_KM) -> DataFrame:
    """One row for each cell within reach.  ``reach`` is a little wide (by 0.5 %), never narrow."""
    columns = round(360 / size)
    reach = radius_km / earth * 180 / math.pi * 1.005 + 1e-9
    rows = F.sequence(F.floor((F.col(lat) - reach + 90) / size).cast("int"), F.floor((F.col(lat) + reach + 90) / size).cast("int"))
    far = F.abs(F.col(lat)) + reach
    span = F.when(far < 89.9, F.least(F.lit(181.0), reach / F.cos(F.radians(far)))).otherwise(F.lit(181.0))
    first = F.floor((F.col(lon) - span + 180) / size).cast("int")
    last = F.floor((F.col(lon) + span + 180) / size).cast("int")
    last = F.least(last, first + F.lit(columns - 1))  # all columns once
    out = points.withColumn("__row", F.explode(rows)).withColumn("__c", F.explode(F.sequence(first, last)))
    return out.withColumn("__col", F.pmod(F.col("__c"), F.lit(columns)).cast("int")).drop("__c")


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, strict: bool = False, earth: float = geo.EARTH_KM, on: tuple[str, ...] = (), spread: str = "left") -> DataFrame:
    """Pairs within ``radius_km``; left has lat, lon and right has rlat, rlon; adds ``km``.

    ``strict`` uses < instead of <=; pairs must be equal in the columns ``on``.  ``spread`` names the
    side that is repeated for the cells it reaches: best the smaller one.
    """
    size = cell_size(radius_km)
    km = geo.haversine("lat", "lon", "rlat", "rlon", earth)
    near = km < radius_km if strict else km <= radius_km
    if spread == "right":
        many, one = with_reach(right, radius_km, size, "rlat", "rlon", earth), with_cell(left, size)
    else:
        many, one = with_reach(left, radius_km, size, earth=earth), with_cell(right, size, "rlat", "rlon")
    many, one, near = by_vectors(many, one, near, radius_km / earth, *(("r", "") if spread == "right" else ("", "r")))
    # The repeated side looks small to the planner, which does not count the repeats: it must not be broadcast.
    met = many.hint("merge").join(one, ["__row", "__col", *on]).where(near).withColumn("km", km)
    columns = [*left.columns, *(c for c in right.columns if c not in on), "km"]
    return met.select(*columns)


def by_vectors(many: DataFrame, one: DataFrame, near: Column, angle: float, p: str, r: str) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides ([p]lat, [p]lon and [r]lat, [r]lon) with unit vectors, whose products settle all pairs but those at the very edge, where ``near`` decides."""
    if angle >= 3.1:
        return many, one, near
    vector = lambda df, x: df.withColumns({f"__{x}v{c}": v for c, v in zip("xyz", geo.unit_xyz(f"{x}lat", f"{x}lon"), strict=True)})
    dot = sum((F.col(f"__{p}v{c}") * F.col(f"__{r}v{c}") for c in "yz"), F.col(f"__{p}vx") * F.col(f"__{r}vx"))
    return vector(many, p), vector(one, r), dot.between(math.cos(angle) + 1e-9, 2.0) | ((dot >= math.cos(angle) - 1e-9) & near)


def spread_of(left: DataFrame, right: DataFrame) -> str:
    """The side with fewer rows, to be repeated by ``radius_join``."""
    return "right" if right.count() < left.count() else "left"


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_km: float, k: int = 1, where: Column | None = None) -> DataFrame:
    """The k nearest within the radius (of pairs under ``where``), ties by the right id; ``rank`` from 1.

    Rings: a radius that holds about eight times k of the right side's points, were they even, comes
    first.  Who finds k there is done, since what lies outside is farther; the others go on to a
    ring three times as wide, and the last one is the radius itself.
    """
    n, spread = right.count(), spread_of(left, right)
    even = geo.EARTH_KM * math.acos(max(-1.0, 1 - 16 * k / max(n, 1)))
    by = W.partitionBy(left_id).orderBy("km", right_id)
    todo, found, ring = left, None, max(1.0, even)
    while True:
        last = ring * 2 >= radius_km
        pairs = radius_join(todo, right, radius_km if last else ring, spread=spread)
        got = (pairs if where is None else pairs.where(where)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        if not last:
            got = written(got, "ring")
            done = got.where(F.col("rank") == k)
            todo = todo.join(done.select(left_id), left_id, "left_anti")
            got = got.join(done.select(left_id), left_id, "left_semi")
        found = got if found is None else found.unionByName(got.select(*found.columns))
        if last or todo.isEmpty():  # a further ring would deal the whole right side for nobody
            return found
        ring *= 3


def nearest_ring(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rings: tuple[float, ...] = (300.0, 3000.0)) -> DataFrame:
    """The nearest without a limit: points not served by a ring go on to the next, wider one, and what is left to ``nearest_far``."""
    todo, found = left, None
    for ring in rings:
        got = written(nearest(todo, right, left_id, right_id, ring).drop("rank"), "ring")
        found = got if found is None else found.unionByName(got)
        todo = todo.join(got.select(left_id), left_id, "left_anti")
    return found.unionByName(nearest_far(todo, right, left_id, right_id))


def nearest_far(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float = 5.0) -> DataFrame:
    """The nearest at any distance, through the cells that can hold it.

    Of the cells that have points (at most 2592 of five degrees) a point meets only those whose near
    edge is no farther than the far edge of some cell; most points meet one or two.
    """
    cells = with_cell(right, size, "rlat", "rlon")
    used = cells.select("__row", "__col").distinct().collect()  # bounded by the globe
    half = geo.EARTH_KM * math.radians(size) * 0.7072 * 1.01
    spots = [F.struct(F.lit(r["__row"]).alias("row"), F.lit(r["__col"]).alias("col"), F.lit((r["__row"] + 0.5) * size - 90).alias("lat"), F.lit((r["__col"] + 0.5) * size - 180).alias("lon")) for r in used]
    if not spots:
        return left.join(right, F.lit(False)).withColumn("km", F.lit(0.0))
    far = F.transform(F.array(*spots), lambda s: F.struct(s.row.alias("row"), s.col.alias("col"), geo.haversine(F.col("lat"), F.col("lon"), s.lat, s.lon).alias("km")))
    measured = left.withColumn("__far", far).withColumn("__least", F.array_min(F.transform("__far", lambda s: s.km)))
    meet = measured.withColumn("__cell", F.explode(F.filter("__far", lambda s: s.km - half <= F.col("__least") + half))).drop("__far", "__least")
    meet = meet.withColumn("__row", F.col("__cell.row")).withColumn("__col", F.col("__cell.col")).drop("__cell")
    pairs = meet.join(cells, ["__row", "__col"]).drop("__row", "__col").withColumn("km", geo.haversine("lat", "lon", "rlat", "rlon"))
    by = W.partitionBy(left_id).orderBy("km", right_id)
    return pairs.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def geocode(asked: DataFrame, gazetteer: DataFrame, countries: DataFrame, key: str, radius_km: float = 25.0) -> DataFrame:
    """(key, id, lat, lon) for asked(key, place): "Name, .., Country" to one of gazetteer(id, name, cc, lat, lon).

    Names are compared in small letters.  The first part is looked up within the country that the
    last part names (countries(last, cc)), or anywhere when it names none or is alone; when that finds
    nothing, the last part is looked up the same way.  Of a name's points the one with most points of that name (and
    country) closer than the radius is taken, ties by id: worked out once a name, not once a question.
    """
    g = gazetteer.withColumn("name", F.lower("name"))
    other = g.select("name", F.col("cc").alias("rcc"), F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    near = radius_join(g, other, radius_km, strict=True, on=("name",)).groupBy("name", "cc", "id", "lat", "lon").agg(F.count("*").alias("any_n"), F.count_if(F.col("cc") == F.col("rcc")).alias("own_n"))
    best = lambda by, n: F.max_by(F.struct("id", "lat", "lon"), F.struct(n, -F.col("id"))).alias(by)
    own, anywhere = near.groupBy("name", "cc").agg(best("own", "own_n")), near.groupBy("name").agg(best("anywhere", "any_n"))
    parts = F.filter(F.transform(F.split("place", ","), lambda x: F.trim(x)), lambda x: x != "")
    x = asked.select(key, F.transform(parts, lambda x: F.lower(x)).alias("parts")).where(F.size("parts") > 0)
    x = x.select(key, F.element_at("parts", 1).alias("first"), F.when(F.size("parts") > 1, F.element_at("parts", -1)).alias("last"))
    x = x.join(countries.select("last", F.col("cc").alias("asked_cc")), "last", "left")
    for part in ("first", "last"):
        x = x.join(own.select(F.col("name").alias(part), F.col("cc").alias("asked_cc"), F.col("own").alias(f"own_{part}")), [part, "asked_cc"], "left")
        x = x.join(anywhere.select(F.col("name").alias(part), F.col("anywhere").alias(f"any_{part}")), part, "left")
    known = F.col("asked_cc").isNotNull()
    found = F.coalesce(F.when(known, F.col("own_first")).otherwise(F.col("any_first")), F.when(known, F.col("own_last")).otherwise(F.col("any_last")))
    return x.select(key, found.alias("p")).select(key, "p.id", "p.lat", "p.lon")


def box_overlap(left: DataFrame, right: DataFrame, size: float = 5.0) -> DataFrame:
    """Pairs of overlapping boxes: left lat_min.. and right rlat_min..; each pair is made in the cell of its common corner only."""

    def cells(df, p):
        rows = F.sequence(F.floor(F.col(f"{p}lat_min") / size).cast("int"), F.floor(F.col(f"{p}lat_max") / size).cast("int"))
        cols = F.sequence(F.floor(F.col(f"{p}lon_min") / size).cast("int"), F.floor(F.col(f"{p}lon_max") / size).cast("int"))
        return df.withColumn("__row", F.explode(rows)).withColumn("__col", F.explode(cols))

    over = (F.col("lat_min") <= F.col("rlat_max")) & (F.col("rlat_min") <= F.col("lat_max")) & (F.col("lon_min") <= F.col("rlon_max")) & (F.col("rlon_min") <= F.col("lon_max"))
    corner = (F.floor(F.greatest("lat_min", "rlat_min") / size) == F.col("__row")) & (F.floor(F.greatest("lon_min", "rlon_min") / size) == F.col("__col"))
    return cells(left, "").join(cells(right, "r"), ["__row", "__col"]).where(over & corner).drop("__row", "__col")


def boxes_near(points: DataFrame, boxes: DataFrame, radius_km: float, tiers_km: tuple[float, ...] = (50.0, 500.0, 5000.0)) -> DataFrame:
    """(point, box) with the clamped distance <= radius; boxes are split by half-diagonal so that large ones do not widen every reach."""
    half = geo.half_diagonal_km("lat_min", "lat_max", "lon_min", "lon_max")
    sized = boxes.withColumn("rlat", (F.col("lat_min") + F.col("lat_max")) / 2).withColumn("rlon", (F.col("lon_min") + F.col("lon_max")) / 2).withColumn("__half", half)
    out, low = None, -1.0
    largest = sized.agg(F.max("__half")).first()[0] or 0.0  # the last tier reaches as far as its largest box, not round the globe
    for top in (*(k for k in tiers_km if k < largest), max(0.0, largest)):
        tier = sized.where((F.col("__half") > low) & (F.col("__half") <= top))
        # The centre is at most the half-diagonal (and a little, for the sphere) beyond the box's nearest point.
        got = radius_join(points, tier, min(20100.0, radius_km + 1.2 * top + 1)).drop("km")
        out = got if out is None else out.unionByName(got)
        low = top
    km = geo.box_km("lat", "lon", "lat_min", "lat_max", "lon_min", "lon_max")
    return out.withColumn("km", km).where(F.col("km") <= radius_km).drop("__half")


def label_grid(gallery: DataFrame, label: str, size: float) -> DataFrame:
    """The most common label of each cell (ties: the smaller label)."""
    cells = gallery.groupBy(geo.cell("lat", size, -90.0).alias("r"), geo.cell("lon", size, -180.0).alias("c"), label).agg(F.count("*").alias("n"))
    by = W.partitionBy("r", "c").orderBy(F.desc("n"), label)
    return cells.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("r", "c", F.col(label).alias("found"))


def label_with_fallback(points: DataFrame, gallery: DataFrame, label: str, sizes: tuple[float, ...] = (0.1, 0.5, 2.0)) -> DataFrame:
    """Label points by the first grid, fine to coarse, whose cell has one."""
    out, names = points, []
    for i, size in enumerate(sizes):
        grid = label_grid(gallery, label, size).select(F.col("r").alias(f"r{i}"), F.col("c").alias(f"c{i}"), F.col("found").alias(f"f{i}"))
        out = out.withColumn(f"r{i}", geo.cell("lat", size, -90.0)).withColumn(f"c{i}", geo.cell("lon", size, -180.0)).join(grid, [f"r{i}", f"c{i}"], "left").drop(f"r{i}", f"c{i}")
        names.append(f"f{i}")
    return out.withColumn("found", F.coalesce(*names)).drop(*names)


def cell_density(points: DataFrame, gallery: DataFrame, point_id: str, size: float, reach: int) -> DataFrame:
    """How many gallery points lie in the (2 reach + 1) squared cells around each point; columns wrap."""
    columns = math.ceil(360 / size - 1e-9)  # the last one may be narrower
    counts = gallery.groupBy(geo.cell("lat", size, -90.0).alias("r"), F.pmod(geo.cell("lon", size, -180.0), F.lit(columns)).alias("c")).agg(F.count("*").alias("n"))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = points.withColumn("r", F.explode(F.transform(steps, lambda d: geo.cell("lat", size, -90.0) + d))).withColumn("c", F.explode(F.transform(steps, lambda d: F.pmod(geo.cell("lon", size, -180.0) + d, F.lit(columns)))))
    return around.join(counts, ["r", "c"], "left").groupBy(point_id).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("density"))


def in_polygon(points: DataFrame, polygons: DataFrame, size: float = 5.0) -> DataFrame:
    """(point, polygon) containment: bounding-box cells, then ray casting in an Arrow function.

    ``polygons`` has rings: array<array<struct<lat,lon>>> (outer ring first, holes after) and a box lat_min.. .
    """
    rows = F.sequence(F.floor(F.col("lat_min") / size).cast("int"), F.floor(F.col("lat_max") / size).cast("int"))
    cols = F.sequence(F.floor(F.col("lon_min") / size).cast("int"), F.floor(F.col("lon_max") / size).cast("int"))
    boxes = polygons.withColumn("__row", F.explode(rows)).withColumn("__col", F.explode(cols))
    cells = points.withColumn("__row", F.floor(F.col("lat") / size).cast("int")).withColumn("__col", F.floor(F.col("lon") / size).cast("int"))
    boxed = cells.join(boxes, ["__row", "__col"]).where(F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max")))
    return boxed.where(contains("lat", "lon", "rings")).drop("__row", "__col")


def contains(lat, lon, rings) -> Column:
    """Even-odd rule over all rings, without Python: count the edges that a ray to the east crosses.  A point on an edge, of a hole as well, is inside."""
    lat, lon = F.col(lat), F.col(lon)

    def sides(ring):
        return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def on_edge(ring):
        line = lambda e: (e.b.lon - e.a.lon) * (lat - e.a.lat) == (lon - e.a.lon) * (e.b.lat - e.a.lat)
        return F.exists(sides(ring), lambda e: lat.between(F.least(e.a.lat, e.b.lat), F.greatest(e.a.lat, e.b.lat)) & lon.between(F.least(e.a.lon, e.b.lon), F.greatest(e.a.lon, e.b.lon)) & line(e))

    def crossings(ring):
        cross = F.filter(sides(ring), lambda e: ((e.a.lat > lat) != (e.b.lat > lat)) & (lon < (e.b.lon - e.a.lon) * (lat - e.a.lat) / (e.b.lat - e.a.lat) + e.a.lon))
        return F.size(cross)

    return (F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, x: s + x) % 2 == 1) | F.exists(rings, on_edge)


def polygon_km2(rings) -> Column:
    """Area on the authalic sphere by the trapezoid rule over longitude; holes are taken off."""

    def ring_area(ring):
        ends = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.radians(b.lon - a.lon) * (2 + F.sin(F.radians(a.lat)) + F.sin(F.radians(b.lat))))
        return F.abs(F.aggregate(ends, F.lit(0.0), lambda s, x: s + x)) * (6371.0072**2) / 2

    areas = F.transform(rings, ring_area)
    return 2 * F.element_at(areas, 1) - F.aggregate(areas, F.lit(0.0), lambda s, x: s + x)


def disc_stats(points: DataFrame, raster: DataFrame, point_id: str, radius_km: float) -> DataFrame:
    """Mean and variance of raster cells (rlat, rlon, value; null is sea) whose centre is within the radius."""
    return radius_join(points, raster.where("value is not null"), radius_km).groupBy(point_id).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.count("*").alias("n"))
