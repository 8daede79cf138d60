"""Sources, sinks and incremental scans: files of each format are written from the given tables and read with the reader of that format."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import geo, hashing, vectors
from stratalens.operators import ordering, spatial
from stratalens.plans.base import hav_sql, lat_sql, lon_sql, points, points_sql, q, r6, t
from stratalens.sources import archives, mapobjects, readers, writers
from stratalens.sources.shared import fresh, written
from stratalens.streaming import incremental


@q("src01_embedding_rows", "SELECT vec_id, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings WHERE vec_id IN (0, 7, (SELECT max(vec_id) FROM embeddings))")
def _(spark, d):
    """Random access by row key; -1 is the last row."""
    e = t(spark, d, "embeddings")
    asked = spark.createDataFrame([(0,), (7,), (-1,)], "row long")
    last = e.agg((F.max("vec_id") + 1).alias("n"))
    rows = asked.join(F.broadcast(last)).select(F.when(F.col("row") < 0, F.col("row") + F.col("n")).otherwise(F.col("row")).alias("vec_id"))
    return e.join(F.broadcast(rows), "vec_id").select("vec_id", F.size("embedding").cast("long").alias("dim"), r6(F.element_at("embedding", 1).cast("double"), "first", 5))


@q("src02_safe_names", "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z0-9_.-]+')")
def _(spark, d):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("../"), "p_name")).otherwise(F.regexp_replace("p_name", " ", "_"))
    return t(spark, d, "part").where(raw.rlike(r"^[A-Za-z0-9_.-]+$") & ~raw.contains("..")).select("p_partkey")


@q("src03_path_resolution", "SELECT c_custkey AS id, 's' || (c_custkey % 3) || '/' || c_custkey || '.jpg' AS path FROM customer")
def _(spark, d):
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    files = c.select(F.explode(F.array(F.concat(F.lit("s"), (k % 3).cast("string"), F.lit("/"), k.cast("string"), F.lit(".jpg")), F.concat(F.lit("t/"), k.cast("string"), F.lit(".png")))).alias("path"))
    ids = c.select(k.cast("string").alias("id"))
    return readers.resolve_paths(ids, files).select(F.col("id").cast("long").alias("id"), "path")


@q("src04_benchmark_join_cache", f"SELECT e.vec_id AS row, round(lat, 6) AS lat, round(lon, 6) AS lon, len(embedding) AS dim FROM embeddings e JOIN {points_sql('customer', 'c_custkey')} c ON c.c_custkey = e.vec_id WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def _(spark, d):
    """A benchmark CSV (some places are not numbers, some out of range) against the embedding cache, in cache order."""
    c = points(spark, d, "customer", "c_custkey")
    k = F.col("c_custkey")
    lines = c.select(k.alias("IMG_ID"), F.when(k % 7 == 0, "NA").otherwise(F.col("lat").cast("string")).alias("LAT"), F.when(k % 11 == 0, F.lit(999.0)).otherwise(F.col("lon")).alias("LON"))
    path = _stored(spark, lines, lambda df, p: df.write.csv(p, header=True))
    bench = readers.points_csv(spark, path, "IMG_ID long, LAT double, LON double", "LAT", "LON")
    cache = t(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.col("vec_id").alias("IMG_ID"), "embedding")
    got = cache.join(bench, "IMG_ID").orderBy("row")
    return got.select("row", r6("LAT", "lat"), r6("LON", "lon"), F.size("embedding").cast("long").alias("dim"))


@q("src05_gazetteer_aliases", f"SELECT p_partkey AS id, unnest([p_name, p_brand]) AS alias, round({lat_sql('p_partkey')}, 6) AS lat, p_size AS population FROM part")
def _(spark, d):
    """A gazetteer of 19 tab-separated columns, aliases split: names, repeats and empty ones."""
    k, gap = F.col("p_partkey"), F.lit("")
    cells = [k.cast("string"), "p_name", "p_name", F.concat(F.col("p_name"), F.lit(",,"), F.col("p_brand"), F.lit(",")), geo.derived_lat("p_partkey").cast("string"), geo.derived_lon("p_partkey").cast("string"), *[gap] * 8, F.col("p_size").cast("string"), *[gap] * 4]
    path = _stored(spark, t(spark, d, "part").select(F.concat_ws("\t", *cells).alias("value")), lambda df, p: df.write.text(p))
    return readers.gazetteer(spark, path).select("id", "alias", r6("lat", "lat"), F.col("population").cast("int").alias("population"))


@q("src06_country_table", "SELECT phone, arg_min(n_name, n_nationkey) AS cc FROM (SELECT n_name, n_nationkey, unnest([CAST(n_regionkey + 1 AS VARCHAR), CAST(40 + n_nationkey % 6 AS VARCHAR)]) AS phone FROM nation) GROUP BY 1")
def _(spark, d):
    """A table with comments and several codes a row; the first row of a code wins."""
    n = F.col("n_nationkey")
    row = F.concat(F.col("n_name"), F.lit("\t+"), (F.col("n_regionkey") + 1).cast("string"), F.lit(" and +"), (40 + n % 6).cast("string"))
    lines = t(spark, d, "nation").orderBy("n_nationkey").coalesce(1).select(F.explode(F.array(F.concat(F.lit("# "), F.col("n_name")), row)).alias("value"))
    return readers.country_codes(spark, _stored(spark, lines, lambda df, p: df.write.text(p)))


@q("src07_nested_projection", "SELECT event_id, event_type AS kind FROM events WHERE props IS NOT NULL AND event_type <> 'error'")
def _(spark, d):
    x = t(spark, d, "events").select("event_id", F.struct(F.struct(F.col("event_type").alias("primary")).alias("names"), "props").alias("rec"))
    return x.where("rec.props is not null and rec.names.primary <> 'error'").select("event_id", F.col("rec.names.primary").alias("kind"))


@q("src08_cell_ordered_scan", f"SELECT c_custkey, CAST(floor((lat + 90) / 10) AS INTEGER) AS r, CAST(floor((lon + 180) / 10) AS INTEGER) AS c FROM {points_sql('customer', 'c_custkey')}")
def _(spark, d):
    x = points(spark, d, "customer", "c_custkey").select("c_custkey", geo.cell("lat", 10.0, -90.0).alias("r"), geo.cell("lon", 10.0, -180.0).alias("c"))
    return x.repartitionByRange("r", "c").sortWithinPartitions("r", "c", "c_custkey")


@q("src09_pruned_scan", "SELECT l_returnflag, count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY 1")
def _(spark, d):
    """Parts read with two of their columns only; each part's counts, then those of all parts."""
    path = _stored(spark, t(spark, d, "lineitem"), lambda df, p: writers.rolling_parts(df, p, 20_000))
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("part"), "l_returnflag", "l_orderkey")
    per = rows.groupBy("part", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))
    return per.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@q("src10_key_ranges", "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), s AS (SELECT lo, greatest(1, CAST(ceil((hi - lo + 1) / CAST(8 AS DOUBLE)) AS BIGINT)) AS step FROM b) SELECT CAST(least(7, (o_orderkey - lo) // step) AS INTEGER) AS part, count(*) AS n, min(o_orderkey) AS low FROM orders, s GROUP BY 1")
def _(spark, d):
    """Eight ranges of the primary key, each a scan with its bounds pushed down."""
    low, high = t(spark, d, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    got = readers.by_key_ranges(spark, f"{d}/orders.parquet", "o_orderkey", low, high, 8)
    return got.groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"))


def _packed_files(df, key, pack):
    """A (path, content) row a key, from ``pack(rows as a frame) -> bytes``: stands for files of that format."""

    def run(key_of, pdf):
        import pandas as pd

        return pd.DataFrame({"path": [f"part-{key_of[0]}"], "content": [pack(pdf)]})

    return df.groupBy(key).applyInPandas(run, "path string, content binary")


def _map_file(pdf) -> bytes:
    nodes = [(i, a, b, {"name": f"n{i}"} if i % 3 else {}) for i, a, b in sorted(set(zip(pdf["node"].tolist(), pdf["lat"].tolist(), pdf["lon"].tolist(), strict=True)))]
    refs: dict[int, list[int]] = {}
    for way, node in zip(pdf["way"].tolist(), pdf["node"].tolist(), strict=True):
        refs.setdefault(way, []).append(node)
    roads = set(pdf.loc[pdf["status"] == "F", "way"].tolist())
    ways = [(way, ids, {"highway": "F"} if way in roads else {"building": "yes"}) for way, ids in refs.items()]
    return mapobjects.encode(nodes, ways, [(min(refs), [("way", way, "outer") for way in refs], {"type": "multipolygon"})])


#: References of ways in one file, about.
MAP_ROWS = 50_000


@q("src11_map_objects", f"SELECT o_orderkey AS way, round(min({lat_sql('l_partkey')}), 6) AS lat_min, round(max({lat_sql('l_partkey')}), 6) AS lat_max, count(*) AS refs FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, d):
    """Files of nodes, ways and relations; only ways with the key are kept, then their nodes are joined."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("way"), F.col("o_orderstatus").alias("status"))
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("node"), geo.derived_lat("l_partkey").alias("lat"), geo.derived_lon("l_partkey").alias("lon"))
    # Files grow in number, not in size: a task holds one.
    n = max(8, -(-rows.count() // MAP_ROWS))
    files = written(_packed_files(rows.join(o, "way").withColumn("file", F.pmod(F.xxhash64("way"), F.lit(n))), "file", _map_file), "map-files")
    ways = mapobjects.map_objects(files, ("way",), "highway").select(F.col("id").alias("way"), F.explode("refs").alias("id"))
    nodes = mapobjects.map_objects(files, ("node",)).groupBy("id").agg(F.any_value("lat").alias("lat"))  # a node is in every file that needs it
    return ways.join(nodes, "id").groupBy("way").agg(r6(F.min("lat"), "lat_min"), r6(F.max("lat"), "lat_max"), F.count("*").alias("refs"))


@q("src12_sql_dump", "SELECT p_partkey, p_name || ''', (x' AS name, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size END AS size FROM part")
def _(spark, d):
    """Rows written as dump lines with escapes and NULL, parsed again."""
    k = F.col("p_partkey")
    size = F.when(k % 2 == 0, "NULL").otherwise(F.col("p_size").cast("string"))
    line = F.concat(F.lit("INSERT INTO `part` VALUES ("), k.cast("string"), F.lit(",'"), "p_name", F.lit("\\', (x',"), size, F.lit(");"))
    rows = readers.sql_dump(t(spark, d, "part").select(line.alias("value")))
    f = F.col("fields")
    return rows.select(f[0].cast("long").alias("p_partkey"), f[1].alias("name"), f[2].cast("int").alias("size"))


@q("src13_wiki_pages", "SELECT p_partkey AS id, p_name AS title, p_type AS text FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def _(spark, d):
    """Page elements of an XML dump: other namespaces and redirects are left out."""
    k = F.col("p_partkey")
    turned = F.when(k % 5 == 0, '<redirect title="x"/>').otherwise("")
    page = F.concat(F.lit("<page><title>"), "p_name", F.lit("</title><ns>"), F.when(k % 3 == 0, "4").otherwise("0"), F.lit("</ns><id>"), k.cast("string"), F.lit("</id>"), turned, F.lit('<revision><text xml:space="preserve">'), "p_type", F.lit("</text></revision></page>"))
    ends = spark.createDataFrame([(-1, "<mediawiki>"), (1 << 62, "</mediawiki>")], "at long, value string")
    lines = t(spark, d, "part").select(k.cast("long").alias("at"), page.alias("value")).union(ends).orderBy("at").coalesce(1).select("value")
    return readers.xml_pages(spark, _stored(spark, lines, lambda df, p: df.write.text(p)))


def search_dump(docs):
    """A bulk file of an index line and a document line a row, read again."""
    doc = F.to_json(F.struct("doc_id", "lang"))
    lines = docs.select(F.explode(F.array(F.concat(F.lit('{"index":{"_id":'), F.col("doc_id").cast("string"), F.lit("}}")), doc)).alias("value"))
    path = _stored(docs.sparkSession, lines, lambda df, p: df.write.text(p))
    return readers.search_dump(docs.sparkSession, path, "doc_id long, lang string")


@q("src14_search_dump", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    return search_dump(t(spark, d, "documents"))


@q("src15_shard_members", "SELECT p_partkey AS id, md5(p_name || '|' || p_type) AS digest FROM part")
def _(spark, d):
    """One long archive in shards of 1000 bytes, and an index of where each member lies: members are cut out of one or more shards."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_type").cast("binary").alias("member")).withColumn("size", F.octet_length("member").cast("long"))
    placed = ordering.summed(p, "id", "size", "offset")
    n = F.col("offset")
    spans = F.sequence(F.floor(n / 1000), F.floor((n + F.col("size") - 1) / 1000))
    cut = placed.select("member", "offset", "size", F.explode(spans).alias("shard"))
    start = F.greatest(F.lit(0), F.col("shard") * 1000 - n)
    stop = F.least(F.col("size"), (F.col("shard") + 1) * 1000 - n)
    part = F.struct((n + start).alias("at"), F.substr("member", (start + 1).cast("int"), (stop - start).cast("int")).alias("bytes"))
    shards = cut.groupBy("shard").agg(F.aggregate(F.array_sort(F.collect_list(part)), F.lit(b""), lambda s, x: F.concat(s, x.bytes)).alias("content"))
    got = archives.sharded_members(spark.read.parquet(_stored(spark, shards, lambda df, to: df.write.parquet(to))), placed.select("id", "offset", "size"))
    return got.select("id", F.md5("content").alias("digest"))


def _zip_file(pdf) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, text in zip(pdf["p_partkey"], pdf["text"], strict=True):
            z.writestr(f"{'in' if i % 3 else 'out'}/{i}.txt", text, zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED)
    return out.getvalue()


@q("src16_zip_members", "SELECT 'in/' || p_partkey || '.txt' AS name, length(p_name) AS size, md5(p_name) AS digest FROM part WHERE p_partkey % 3 <> 0")
def _(spark, d):
    """Members of ZIP files by their own directory and ranged reads; only the wanted ones are unpacked."""
    files = _packed_files(t(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), (F.col("p_partkey") % 5).alias("file")), "file", _zip_file)
    return archives.zip_members(files, r"in/.*").select("name", "size", F.md5("content").alias("digest"))


@q("src17_json_lines", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    line = F.to_json(F.struct("event_id", "event_type", "props"))
    x = t(spark, d, "events").select(F.from_json(line, "event_id long, event_type string, props string").alias("x")).select("x.*")
    return x.select("event_id", "event_type", F.from_json("props", "k long").k.alias("k"))


def _npz_file(pdf) -> bytes:
    import io

    import numpy as np

    out = io.BytesIO()
    np.savez_compressed(out, ids=pdf["vec_id"].to_numpy(np.float64), x=np.stack(pdf["embedding"].to_numpy()))
    return out.getvalue()


@q("src18_matrix_rows", "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def _(spark, d):
    """Two arrays of NPZ files, met by file and row."""
    # Written once: both arrays are read from the same files, whatever order the rows came in.
    files = written(_packed_files(t(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 4).alias("file")), "file", _npz_file), "npz-files")
    ids = archives.npz_rows(files, "ids").select("path", "row", F.element_at("value", 1).cast("long").alias("vec_id"))
    total = F.aggregate(vectors.doubles("value"), F.lit(0.0), lambda s, x: s + x)
    return archives.npz_rows(files, "x").join(ids, ["path", "row"]).select("vec_id", r6(total, "total", 4))


@q("src19_paged_windows", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, bool_and(up + down - 1 <= 300) AS complete FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS down FROM events) WHERE up <= 150 OR down <= 150 GROUP BY 1")
def _(spark, d):
    """A service that gives 150 rows an answer, asked for each day from both ends."""
    got = readers.paged_scan(t(spark, d, "events").select("event_id", "ts"), F.to_date("ts"), ["ts", "event_id"], 150)
    return got.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.every("complete").alias("complete"))


NEAREST3 = f"(SELECT s_suppkey, c_custkey, {hav_sql('lat', 'lon', 'rlat', 'rlon')} AS km FROM {points_sql('supplier', 's_suppkey')}, {points_sql('customer', 'c_custkey', 'r')})"


@q("src20_cached_search", f"SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'cache' ELSE 'index' END AS src, rank, c_custkey, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, c_custkey) AS rank FROM {NEAREST3} WHERE km <= 500) WHERE rank <= 3")
def _(spark, d):
    """Places near a point: even suppliers were asked for before and are answered from the stored answers, the rest by the index."""
    c = points(spark, d, "customer", "c_custkey", "r")
    s = points(spark, d, "supplier", "s_suppkey").withColumn("key", F.concat_ws("_", F.format_number("lat", 4), F.format_number("lon", 4), F.col("s_suppkey").cast("string")))

    def index(missing):
        near = spatial.nearest(missing.select("key", "lat", "lon"), c, "key", "c_custkey", 500.0, 3)
        hits = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "c_custkey", "km")))
        return near.groupBy("key").agg(F.to_json(hits).alias("answer"))

    path = fresh(spark, "answers")
    readers.cached_search(s.where("s_suppkey % 2 = 0"), path, index)
    got = readers.cached_search(s, path, index)
    hit = F.explode(F.from_json("answer", "array<struct<rank:long,c_custkey:long,km:double>>")).alias("h")
    return got.select("s_suppkey", "src", hit).select("s_suppkey", "src", "h.rank", "h.c_custkey", r6("h.km", "km", 4))


@q("src21_tile_points", f"SELECT c_custkey, round(x / CAST(16384 AS DOUBLE) * 360 - 180, 6) AS lon FROM (SELECT c_custkey, CAST(floor((lon + 180) / 360 * 16384) AS INTEGER) AS x FROM {points_sql('customer', 'c_custkey')})")
def _(spark, d):
    x, y = geo.tile("lat", "lon", 14)
    c = points(spark, d, "customer", "c_custkey").select("c_custkey", x.alias("x"), y.alias("y"))
    return c.select("c_custkey", r6(geo.tile_point("x", "y", 14)[1], "lon"))


@q("src22_raster_long", f"SELECT r, c, channel, count(*) AS n, round(avg(value), 6) AS value FROM (SELECT CAST(floor((lat + 90) / 30) AS INTEGER) AS r, CAST(floor((lon + 180) / 30) AS INTEGER) AS c, unnest(['size', 'price']) AS channel, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS value FROM {points_sql('part', 'p_partkey', '', 'p_size, p_retailprice')}) GROUP BY ALL")
def _(spark, d):
    p = points(spark, d, "part", "p_partkey", "", "p_size", "p_retailprice").select(geo.cell("lat", 30.0, -90.0).alias("r"), geo.cell("lon", 30.0, -180.0).alias("c"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot(["r", "c"], ["size", "price"], "channel", "value").groupBy("r", "c", "channel").agg(F.count("*").alias("n"), r6(F.avg("value"), "value"))


# -- sinks: what would be written ----------------------------------------------------------------


def _stored(spark, df, how):
    """Write to a fresh place in the shared folder and read it again."""
    path = fresh(spark, "sink")
    how(df, path)
    return path


@q("snk01_cache_manifest", "SELECT vec_id, len(embedding) AS dim FROM embeddings")
def _(spark, d):
    path = _stored(spark, t(spark, d, "embeddings"), lambda df, p: writers.cache_with_manifest(df, p, {"dim": 64, "format": "v1"}))
    return spark.read.parquet(f"{path}/data").select("vec_id", F.size("embedding").cast("long").alias("dim"))


@q("snk02_rolling_parts", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def _(spark, d):
    path = _stored(spark, t(spark, d, "lineitem").select("l_orderkey"), lambda df, p: writers.rolling_parts(df, p, 5000))
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@q("snk03_incremental_writer", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    path = _stored(spark, t(spark, d, "nation"), lambda df, p: [df.where(f"n_nationkey % 2 = {k}").write.mode("append").parquet(p) for k in (0, 1)])
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@q("snk04_lookup_table", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    """A bulk build with its index: a table bucketed and sorted by the lookup key."""
    name = f"lookup_{uuid.uuid4().hex}"
    writers.clustered_table(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), name, "o_custkey", 8, fresh(spark, name))
    lookup = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only; the files go with the run's folder
    return t(spark, d, "orders").join(lookup.hint("shuffle_merge"), "o_custkey").select("o_orderkey", "c_mktsegment")


@q("snk05_json_lines", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}' AS line FROM nation")
def _(spark, d):
    path = _stored(spark, t(spark, d, "nation").select("n_nationkey", "n_name"), writers.json_lines)
    x = spark.read.text(path)
    return x.select(F.from_json("value", "n_nationkey int").n_nationkey.alias("n_nationkey"), F.col("value").alias("line"))


@q("snk06_replace_whole", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, d):
    """A table replaced as a whole, by renaming what was written beside it."""

    def twice(df, p):
        writers.replace_whole(df.where("n_nationkey % 2 = 0"), p)
        writers.replace_whole(df.where("n_nationkey % 2 = 1"), p)

    return spark.read.parquet(_stored(spark, t(spark, d, "nation").select("n_nationkey", "n_name"), twice))


@q("snk07_release_csv", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    path = _stored(spark, t(spark, d, "nation").withColumn("pid", hashing.opaque("rel", "n_nationkey")), lambda df, p: writers.release_csv(df, p, "pid"))
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int, pid string").csv(path, header=True).select("n_nationkey", "n_name")


@q("snk08_resumable_append", "SELECT s_suppkey FROM supplier")
def _(spark, d):
    """Half is stored; a second run appends only what is missing."""
    s = t(spark, d, "supplier").select("s_suppkey")

    def twice(df, p):
        writers.append_missing(df.where("s_suppkey % 2 = 0"), p, "s_suppkey")
        writers.append_missing(df, p, "s_suppkey")

    return spark.read.parquet(_stored(spark, s, twice))


@q("snk09_parts_coverage", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    """Parts overwritten on their own; the rest stays."""

    def parts(df, p):
        writers.overwrite_parts(df, p, "c_nationkey")
        writers.overwrite_parts(df.where("c_nationkey = 3"), p, "c_nationkey")

    path = _stored(spark, t(spark, d, "customer").select("c_custkey", "c_nationkey"), parts)
    return spark.read.parquet(path).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@q("snk10_staged_copy", "SELECT count(*) AS n, sum(o_custkey) AS total FROM orders")
def _(spark, d):
    """A table copied to a staging folder; the copy is read only because its files have the sizes of the original's."""
    path = _stored(spark, t(spark, d, "orders").select("o_orderkey", "o_custkey"), lambda df, p: writers.rolling_parts(df, p, 5000))
    writers.staged_copy(spark, path, f"{path}-staged")
    return spark.read.parquet(f"{path}-staged").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@q("snk11_public_private", "SELECT 'public' AS \"table\", count(*) AS rows FROM supplier UNION ALL SELECT 'private', count(*) FROM supplier")
def _(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("truth"))
    out = {}
    _stored(spark, s, lambda df, p: out.update(x=writers.public_private(df, f"{p}/public", f"{p}/private", "s_suppkey")))
    return out["x"].select("table", "rows")


# -- incremental ---------------------------------------------------------------------------------


@q("stm01_incremental_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(spark, d):
    """Two passes over a folder through one checkpoint: the second finds nothing new, and no id twice."""
    base = fresh(spark, "stream")
    schema = t(spark, d, "events").schema.simpleString()[7:-1]
    fields = ", ".join(f.replace(":", " ", 1) for f in schema.split(","))
    for _ in range(2):
        rows = incremental.new_rows(spark, f"{d}/events.parquet*", fields, "event_id")
        incremental.append_to(rows, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@q("stm02_worker_striping", "SELECT doc_id % 4 AS worker, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    """Rows dealt to workers by row number, shuffled within a worker by a hash."""
    x = t(spark, d, "documents").select((F.col("doc_id") % 4).alias("worker"), "doc_id")
    dealt = x.repartition(4, "worker").sortWithinPartitions("worker", hashing.order("buf", "doc_id"))
    return dealt.groupBy("worker").agg(F.count("*").alias("n"))


@q("stm03_worker_queue", "SELECT count(*) AS n, sum(doc_id) AS total FROM documents")
def _(spark, d):
    """Four workers, each with a sentinel that says how many results it gave; all have ended before a result is used."""

    def work(_, batches):
        for pdf in batches:
            yield from pdf["doc_id"].tolist()

    got = incremental.worked(t(spark, d, "documents").select("doc_id"), 4, "doc_id", work)
    return got.agg(F.count("*").alias("n"), F.sum("result").alias("total"))


@q("stm04_job_states", "SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'error' THEN event_id END) > coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), -1) THEN 'failed' WHEN max(CASE WHEN event_type = 'purchase' THEN event_id END) IS NOT NULL THEN 'completed' WHEN max(CASE WHEN event_type = 'click' THEN event_id END) IS NOT NULL THEN 'running' ELSE 'queued' END AS state FROM events GROUP BY 1")
def _(spark, d):
    """The last transition of each job, from its events."""
    last = lambda k: F.max(F.when(F.col("event_type") == k, F.col("event_id")))
    x = t(spark, d, "events").groupBy("user_id").agg(last("error").alias("e"), last("purchase").alias("p"), last("click").alias("c"))
    state = F.when(F.col("e") > F.coalesce("p", F.lit(-1)), "failed").when(F.col("p").isNotNull(), "completed").when(F.col("c").isNotNull(), "running").otherwise("queued")
    return x.select("user_id", state.alias("state"))


PACE = "SELECT event_id, user_id, epoch_us(ts) AS made, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN event_type = 'error' THEN CAST(event_id % 50 AS DOUBLE) END AS asked FROM events"


@q("stm05_rate_and_backoff", f"SELECT event_id, max(made - 60000000 * i) OVER (PARTITION BY user_id ORDER BY i) + 60000000 * i - made AS waited_us, coalesce(greatest(asked, CAST(0 AS DOUBLE)), least(CAST(30 AS DOUBLE), 2 * (CAST(i AS DOUBLE) + 1))) AS again FROM ({PACE})")
def _(spark, d):
    """Requests of a user start a minute apart at least; a failed one is made again after what the answer said, or a growing wait."""
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("made"))
    e = e.withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    asked = F.when(F.col("event_type") == "error", (F.col("event_id") % 50).cast("double"))
    paced = incremental.paced(e, "user_id", "made", 60_000_000, tie="event_id")
    return paced.select("event_id", (F.col("start") - F.col("made")).alias("waited_us"), incremental.backoff(F.col("i").cast("double"), asked).alias("again"))


@q("stm06_budget_fold", "WITH x AS (SELECT conv_id, turn, sum(1 + length(text) % 5) OVER (PARTITION BY conv_id ORDER BY turn) AS spent FROM conversations) SELECT conv_id, count(*) FILTER (spent <= 9) AS done FROM x GROUP BY 1")
def _(spark, d):
    costs = F.array_sort(F.collect_list(F.struct("turn", (1 + F.length("text") % 5).cast("double").alias("c"))))
    x = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(costs, lambda s: s.c).alias("costs"))
    return x.select("conv_id", incremental.fold_budget(F.col("costs"), 9.0).cast("long").alias("done"))


@q("udf01_reward_bands", "SELECT c_custkey, round(CASE WHEN d < 1 THEN 2 - d / 100 WHEN d < 25 THEN CAST(1.5 AS DOUBLE) - d / 2500 ELSE exp(-d / 1000) END, 6) AS reward FROM (SELECT c_custkey, CAST(c_custkey % 300 AS DOUBLE) / 4 AS d FROM customer)")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", r6(geo.reward_band((F.col("c_custkey") % 300).cast("double") / 4), "reward"))


@q("api01_coverage_summary", "SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS oldest, strftime(max(ts), '%Y-%m-%d') AS newest, round(avg(CAST(value > 10 AS INTEGER)), 6) AS share FROM events GROUP BY 1")
def _(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), day(F.min("ts")).alias("oldest"), day(F.max("ts")).alias("newest"), r6(F.avg((F.col("value") > 10).cast("int")), "share"))
