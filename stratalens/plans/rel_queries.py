"""Projections, filters, joins, aggregates, windows, sorts, sets and samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import geo, hashing
from stratalens.operators import evaluate, ordering, selection
from stratalens.sources.shared import written
from stratalens.plans.base import POOL_SQL, hav_sql, lat_sql, lon_sql, points, points_sql, pool, q, r6, t
from stratalens.plans.geo_queries import P_BOX, boxes

# -- projections ---------------------------------------------------------------------------------


@q("prj01_box_centre", f"SELECT p_partkey, round((lat_min + lat_max) / 2, 6) AS lat, round((lon_min + lon_max) / 2, 6) AS lon FROM {P_BOX}")
def _(spark, d):
    return boxes(spark, d).select("p_partkey", r6((F.col("lat_min") + F.col("lat_max")) / 2, "lat"), r6((F.col("lon_min") + F.col("lon_max")) / 2, "lon"))


@q("prj02_coalesced_name", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 1 THEN p_brand END, p_type) AS name FROM part")
def _(spark, d):
    k = F.col("p_partkey") % 3
    return t(spark, d, "part").select("p_partkey", F.coalesce(F.when(k == 0, F.col("p_name")), F.when(k == 1, F.col("p_brand")), F.col("p_type")).alias("name"))


@q("prj03_address", "SELECT p_partkey, concat_ws(', ', nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), nullif(p_type, ''), CAST(p_size AS VARCHAR)) AS address FROM part")
def _(spark, d):
    brand = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", F.concat_ws(", ", F.nullif(brand, F.lit("")), F.nullif("p_type", F.lit("")), F.col("p_size").cast("string")).alias("address"))


def tags(spark, d):
    """Part columns as a tag map."""
    pairs = [x for k, v in (("brand", "p_brand"), ("type", "p_type"), ("name", "p_name"), ("name:en", "p_type"), ("size", "p_size")) for x in (F.lit(k), F.col(v).cast("string"))]
    return t(spark, d, "part").select("p_partkey", F.create_map(*pairs).alias("tags"))


@q("prj04_kind_string", "SELECT p_partkey, array_to_string(list_filter(['type=' || p_type, 'brand=' || p_brand], lambda x: length(x) < 45 AND NOT contains(x, ';')), ';') AS kinds FROM part")
def _(spark, d):
    keys = F.array(F.lit("type"), F.lit("brand"))
    made = F.transform(F.filter(keys, lambda k: ~F.element_at("tags", k).contains(";") & (F.length(F.element_at("tags", k)) < 40)), lambda k: F.concat(k, F.lit("="), F.element_at("tags", k)))
    return tags(spark, d).select("p_partkey", F.array_join(made, ";").alias("kinds"))


@q("prj05_name_variants", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_name, p_type])), '|') AS variants FROM part")
def _(spark, d):
    names = F.map_values(F.map_filter("tags", lambda k, v: (k == "name") | k.startswith("name:")))
    return tags(spark, d).select("p_partkey", F.array_join(F.array_sort(F.array_distinct(names)), "|").alias("variants"))


@q("prj06_notability", "SELECT p_partkey, greatest(CASE p_type WHEN 'ECONOMY' THEN 3 WHEN 'PROMO' THEN 5 ELSE 0 END, CASE p_brand WHEN 'Brand#2' THEN 4 ELSE 0 END) AS notable FROM part")
def _(spark, d):
    table = F.create_map(*[F.lit(x) for x in ("ECONOMY", 3, "PROMO", 5, "Brand#2", 4)])
    return t(spark, d, "part").select("p_partkey", F.array_max(F.transform(F.array("p_type", "p_brand"), lambda k: F.coalesce(F.try_element_at(table, k), F.lit(0)))).alias("notable"))


@q("prj07_confidence", "SELECT c_custkey, round((greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), c_acctbal / 5000)) + 1) / 2, 6) AS confidence FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", r6((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c_acctbal") / 5000)) + 1) / 2, "confidence"))


MACRO = "CASE WHEN lat < -60 THEN 'antarctic' WHEN lon >= -170 AND lon < -30 AND lat >= 13 THEN 'north america' WHEN lon >= -120 AND lon < -30 THEN 'south america' WHEN lon >= -30 AND lon < 60 AND lat >= 35 THEN 'europe' WHEN lon >= -30 AND lon < 60 THEN 'africa' WHEN lon >= 60 AND lat >= -10 THEN 'asia' ELSE 'oceania' END"


@q("prj08_macro_region", f"SELECT c_custkey, {MACRO} AS region FROM {points_sql('customer', 'c_custkey')}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", geo.macro_region("lat", "lon").alias("region"))


@q("prj09_url_build", "SELECT p_partkey, 'https://example.org/wiki/' || replace(replace(p_name, ' ', '_'), '#', '%23') || '?b=' || replace(p_brand, '#', '%23') AS url FROM part")
def _(spark, d):
    page = F.url_encode(F.regexp_replace("p_name", " ", "_"))
    return t(spark, d, "part").select("p_partkey", F.concat(F.lit("https://example.org/wiki/"), page, F.lit("?b="), F.url_encode("p_brand")).alias("url"))


@q("prj10_target_text", f"SELECT c_custkey, printf('The photo is at %.3f, %.3f in %s.', lat, lon, c_mktsegment) AS target FROM {points_sql('customer', 'c_custkey', '', 'c_mktsegment')}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey", "", "c_mktsegment").select("c_custkey", F.format_string("The photo is at %.3f, %.3f in %s.", "lat", "lon", "c_mktsegment").alias("target"))


@q("prj11_result_cards", f"SELECT qid, pos, 'pool:' || author || ':' || pos AS card_id, round(score, 6) AS score FROM {POOL_SQL} WHERE pos <= 3")
def _(spark, d):
    return pool(spark, d).where("pos <= 3").select("qid", "pos", F.concat_ws(":", F.lit("pool"), F.col("author").cast("string"), F.col("pos").cast("string")).alias("card_id"), r6("score", "score"))


@q("prj12_feature_matrix", f"SELECT qid, pos, round(ln(score), 6) AS log_score, round(ln(1 + score), 6) AS log1p_score, round(score - max(score) OVER (PARTITION BY qid), 6) AS rel, CAST(pos = 1 AS INTEGER) AS r1, CAST(pos = 2 AS INTEGER) AS r2, CAST(pos = 3 AS INTEGER) AS r3 FROM {POOL_SQL}")
def _(spark, d):
    one_hot = [(F.col("pos") == k).cast("int").alias(f"r{k}") for k in (1, 2, 3)]
    return pool(spark, d).select("qid", "pos", r6(F.log("score"), "log_score"), r6(F.log1p("score"), "log1p_score"), r6(F.col("score") - F.max("score").over(W.partitionBy("qid")), "rel"), *one_hot)


@q("prj13_standardise", "SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 5 <> 0)")
def _(spark, d):
    c = t(spark, d, "customer")
    fit = c.where("c_custkey % 5 <> 0").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    return c.join(F.broadcast(fit)).select("c_custkey", r6((F.col("c_acctbal") - F.col("m")) / F.col("s"), "z"))


@q("prj14_unit_coordinates", f"SELECT c_custkey, round(lat / 90, 6) AS y, round(lon / 180, 6) AS x FROM {points_sql('customer', 'c_custkey')}")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").select("c_custkey", r6(F.col("lat") / 90, "y"), r6(F.col("lon") / 180, "x"))


# -- filters -------------------------------------------------------------------------------------


@q("flt01_valid_coordinates", "SELECT event_id FROM events WHERE try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS DOUBLE) BETWEEN -90 AND 90 AND value * 3 BETWEEN -180 AND 180")
def _(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("value").cast("string"))
    return t(spark, d, "events").where(geo.valid(raw.try_cast("double"), F.col("value") * 3)).select("event_id")


@q("flt02_null_island", f"SELECT c_custkey FROM {points_sql('customer', 'c_custkey')} WHERE NOT (abs(lat) < 5 AND abs(lon) < 5)")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey").where(~((F.abs("lat") < 5) & (F.abs("lon") < 5))).select("c_custkey")


@q("flt03_tag_wanted", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand IN ('Brand#2', 'Brand#3')")
def _(spark, d):
    """Wanted when a rule has the key and the value, or the key and ``*``."""
    rules = spark.createDataFrame([("type", "PROMO"), ("brand", "Brand#2"), ("brand", "Brand#3"), ("amenity", "*")], "key string, value string")
    pairs = tags(spark, d).select("p_partkey", F.explode("tags").alias("key", "value"))
    hit = pairs.join(F.broadcast(rules.withColumnRenamed("value", "want")), "key").where("want = value or want = '*'")
    return hit.select("p_partkey").distinct()


@q("flt04_rule_match", "SELECT p_partkey, word FROM (SELECT p_partkey, 'promo big' AS word FROM part WHERE p_type = 'PROMO' AND p_size = 10 UNION ALL SELECT p_partkey, 'any brand2' FROM part WHERE p_brand = 'Brand#2' UNION ALL SELECT p_partkey, 'any brand2' FROM part WHERE p_type = 'ECONOMY' AND p_brand <> 'Brand#2' AND p_brand = 'Brand#3')")
def _(spark, d):
    """OR of ANDs: a rule holds when every one of its terms does."""
    rules = [("promo big", 1, "type", "PROMO"), ("promo big", 1, "size", "10"), ("any brand2", 1, "brand", "Brand#2"), ("any brand2", 1, "name", "*"), ("any brand2", 2, "type", "ECONOMY"), ("any brand2", 2, "brand", "Brand#3")]
    terms = spark.createDataFrame(rules, "word string, rule int, key string, want string")
    size = terms.groupBy("word", "rule").agg(F.count("*").alias("n"))
    pairs = tags(spark, d).select("p_partkey", F.explode("tags").alias("key", "value"))
    held = pairs.join(F.broadcast(terms), "key").where("want = value or want = '*'").groupBy("p_partkey", "word", "rule").agg(F.count("*").alias("m"))
    return held.join(F.broadcast(size), ["word", "rule"]).where("m = n").select("p_partkey", "word").distinct()


@q("flt05_quality_gate", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_retailprice > 920 AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND p_name IS NOT NULL")
def _(spark, d):
    return t(spark, d, "part").where((F.col("p_size") >= 10) & (F.col("p_retailprice") > 920) & F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO") & F.col("p_name").isNotNull()).select("p_partkey")


@q("flt06_source_exclusion", "SELECT p_partkey FROM part WHERE NOT contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#2') AND NOT contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'promo')")
def _(spark, d):
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return t(spark, d, "part").where(~text.contains("brand#2") & ~text.contains("promo")).select("p_partkey")


@q("flt07_bot_accounts", "SELECT DISTINCT user_id FROM events WHERE NOT regexp_matches(CASE WHEN user_id % 4 = 0 THEN 'TidyBot' WHEN user_id % 4 = 1 THEN 'bottle' ELSE 'u' || user_id END, '(?i)bot\\b')")
def _(spark, d):
    k = F.col("user_id") % 4
    name = F.when(k == 0, "TidyBot").when(k == 1, "bottle").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return t(spark, d, "events").where(~name.rlike(r"(?i)bot\b")).select("user_id").distinct()


@q("flt08_author_exclusion", "SELECT a.l_orderkey AS qid, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_orderkey")
def _(spark, d):
    li = t(spark, d, "lineitem")
    a = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("qa"))
    b = li.select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("ga"))
    return a.join(b, "qid").where(F.col("qa").isNull() | F.col("ga").isNull() | (F.col("qa") != F.col("ga"))).groupBy("qid").agg(F.count("*").alias("n"))


@q("flt09_time_guard", "SELECT event_id FROM events WHERE CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END < TIMESTAMP '2024-01-10 00:00:00'")
def _(spark, d):
    when = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return t(spark, d, "events").where(when < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id")


@q("flt10_per_sequence_cap", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS rn FROM events) WHERE rn <= 3")
def _(spark, d):
    by = W.partitionBy("user_id", "event_type").orderBy("value", "event_id")
    return t(spark, d, "events").withColumn("rn", F.row_number().over(by)).where("rn <= 3").select("event_id")


@q("flt11_accuracy_threshold", "SELECT event_id FROM events WHERE value >= 11 AND event_type <> 'error'")
def _(spark, d):
    return t(spark, d, "events").where("value >= 11 and event_type <> 'error'").select("event_id")


MD5 = "((((('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::UBIGINT % 100 * 96 + ('0x' || substr(md5(CAST({k} AS VARCHAR)), 9, 8))::UBIGINT) % 100 * 96 + ('0x' || substr(md5(CAST({k} AS VARCHAR)), 17, 8))::UBIGINT) % 100 * 96 + ('0x' || substr(md5(CAST({k} AS VARCHAR)), 25, 8))::UBIGINT) % 100)"


@q("flt12_hash_split", f"SELECT doc_id, CASE WHEN {MD5.format(k='doc_id')} < 5 THEN 'val' ELSE 'train' END AS split FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.when(hashing.md5_bucket("doc_id") < 5, "val").otherwise("train").alias("split"))


@q("flt13_box_or_open", f"SELECT c_custkey, n_nationkey FROM {points_sql('customer', 'c_custkey', '', 'c_nationkey')} JOIN nation ON c_nationkey = n_nationkey AND (n_nationkey % 3 = 0 OR lat BETWEEN n_nationkey * 3 - 60 AND n_nationkey * 3)")
def _(spark, d):
    """A box of nulls restricts nothing."""
    low = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") * 3 - 60)
    n = t(spark, d, "nation").select("n_nationkey", low.alias("low"), (low + 60).alias("high"))
    c = points(spark, d, "customer", "c_custkey", "", "c_nationkey")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).where(F.col("low").isNull() | F.col("lat").between(F.col("low"), F.col("high"))).select("c_custkey", "n_nationkey")


@q("flt14_region_or_open", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE CASE WHEN s_suppkey % 4 = 0 THEN TRUE ELSE n_regionkey = s_suppkey % 7 END")
def _(spark, d):
    """Null restricts nothing; an unknown label (5, 6) matches nothing."""
    s = t(spark, d, "supplier").withColumn("want", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 7))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return s.join(F.broadcast(n), "s_nationkey").where(F.col("want").isNull() | (F.col("want") == F.col("n_regionkey"))).select("s_suppkey")


@q("flt15_leave_one_out", f"SELECT qid, count(*) AS n FROM (SELECT a.s_nationkey AS qid, {hav_sql('a.rlat', 'a.rlon', 'b.rlat', 'b.rlon')} AS km, a.s_suppkey AS a, b.s_suppkey AS b FROM {points_sql('supplier', 's_suppkey', 'r', 's_nationkey')} a JOIN {points_sql('supplier', 's_suppkey', 'r', 's_nationkey')} b USING (s_nationkey)) WHERE a <> b AND km > 1000 GROUP BY qid")
def _(spark, d):
    s = points(spark, d, "supplier", "s_suppkey", "r", "s_nationkey")
    a = s.select(F.col("s_suppkey").alias("a"), F.col("rlat").alias("la"), F.col("rlon").alias("lo"), "s_nationkey")
    return a.join(s, "s_nationkey").where((F.col("a") != F.col("s_suppkey")) & (geo.haversine("la", "lo", "rlat", "rlon") > 1000)).groupBy(F.col("s_nationkey").alias("qid")).agg(F.count("*").alias("n"))


@q("flt16_specific_clues", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.08 AND p_type = 'PROMO'")
def _(spark, d):
    p = t(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return t(spark, d, "lineitem").where("l_discount >= 0.08D").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@q("flt17_generic_spans", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3 AND w NOT IN ('small', 'large', 'blue'))) > 0")
def _(spark, d):
    words = F.split("p_name", " ")
    return t(spark, d, "part").where(~F.forall(words, lambda w: (F.length(w) <= 3) | w.isin("small", "large", "blue"))).select("p_partkey")


@q("flt18_status_exclusion", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


# -- joins ---------------------------------------------------------------------------------------


@q("jn01_inner_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t(spark, d, "supplier").join(n, "s_nationkey").select("s_suppkey", "n_name")


@q("jn02_lookup_or_minus_one", "SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@q("jn03_row_mapping", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    """Every row must map; a missing one fails the query when it runs."""
    o, c = t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").select("c_custkey")
    got = o.join(c, o.o_custkey == c.c_custkey, "left")
    return got.select("o_orderkey", F.coalesce("c_custkey", F.raise_error(F.lit("an order without its customer")).cast("long")).alias("c_custkey"))


@q("jn04_left_join", "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000 GROUP BY 1")
def _(spark, d):
    s = t(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return t(spark, d, "nation").join(s, "n_nationkey", "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n"))


@q("jn05_left_join_chain", "SELECT n_nationkey, a.n AS suppliers, b.n AS customers, round(c.m, 2) AS best_supplier, round(e.m, 2) AS best_customer, r_name FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier GROUP BY 1) a USING (n_nationkey) LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) b USING (n_nationkey) LEFT JOIN (SELECT s_nationkey AS n_nationkey, max(s_acctbal) AS m FROM supplier GROUP BY 1) c USING (n_nationkey) LEFT JOIN (SELECT c_nationkey AS n_nationkey, max(c_acctbal) AS m FROM customer GROUP BY 1) e USING (n_nationkey) LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    s = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"), r6(F.max("s_acctbal"), "best_supplier", 2))
    c = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), r6(F.max("c_acctbal"), "best_customer", 2))
    r = t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return t(spark, d, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").join(r, "n_regionkey", "left").select("n_nationkey", "suppliers", "customers", "best_supplier", "best_customer", "r_name")


@q("jn06_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@q("jn08_box_and_text", f"SELECT p_partkey FROM {P_BOX} WHERE lat_max >= 0 AND lat_min <= 40 AND p_partkey IN (SELECT p_partkey FROM part WHERE contains(p_name, 'blue'))")
def _(spark, d):
    named = t(spark, d, "part").where(F.col("p_name").contains("blue")).select("p_partkey")
    return boxes(spark, d).where("lat_max >= 0 and lat_min <= 40").join(named, "p_partkey", "left_semi").select("p_partkey")


@q("jn09_tail_join_residual", "SELECT a.o_orderkey, b.c_custkey FROM orders a JOIN customer b ON a.o_orderkey % 1000 = b.c_custkey % 1000 AND ends_with(CAST(a.o_orderkey AS VARCHAR), CAST(b.c_custkey AS VARCHAR)) WHERE b.c_custkey >= 100")
def _(spark, d):
    """Keys share a fixed tail (equi-join); the rest must be a suffix (residual)."""
    o = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("tail"))
    c = t(spark, d, "customer").where("c_custkey >= 100").select("c_custkey", (F.col("c_custkey") % 1000).alias("tail"))
    return o.join(c, "tail").where(F.col("o_orderkey").cast("string").endswith(F.col("c_custkey").cast("string"))).select("o_orderkey", "c_custkey")


@q("jn10_alias_nocase", "SELECT a.r_regionkey AS alias_key, b.r_regionkey AS target FROM region a JOIN region b ON lower(a.r_name) = lower(upper(b.r_name))")
def _(spark, d):
    a = t(spark, d, "region").select(F.col("r_regionkey").alias("alias_key"), F.lower("r_name").alias("k"))
    b = t(spark, d, "region").select(F.col("r_regionkey").alias("target"), F.lower(F.upper("r_name")).alias("k"))
    return a.join(b, "k").select("alias_key", "target")


@q("jn11_id_list_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 17, 42, 99, 123456789)")
def _(spark, d):
    ids = spark.createDataFrame([(3,), (17,), (42,), (99,), (123456789,)], "doc_id long")
    return t(spark, d, "documents").select("doc_id", "lang").join(F.broadcast(ids), "doc_id")


@q("jn12_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def _(spark, d):
    used = t(spark, d, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    blocked = t(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return t(spark, d, "customer").join(used, "c_custkey", "left_anti").join(blocked, "c_nationkey", "left_anti").select("c_custkey")


@q("jn13_anti_hashed_group", "SELECT c_custkey FROM customer WHERE substr(sha256('grp:' || c_nationkey), 1, 12) NOT IN (SELECT substr(sha256('grp:' || s_nationkey), 1, 12) FROM supplier WHERE s_acctbal > 8000)")
def _(spark, d):
    banned = t(spark, d, "supplier").where("s_acctbal > 8000").select(hashing.opaque("grp", "s_nationkey").alias("g"))
    return t(spark, d, "customer").withColumn("g", hashing.opaque("grp", "c_nationkey")).join(banned, "g", "left_anti").select("c_custkey")


@q("jn14_composite_key", "SELECT a.conv_id, a.turn, coalesce(b.n, 0) AS score FROM conversations a LEFT JOIN (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user') b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
def _(spark, d):
    c = t(spark, d, "conversations")
    b = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").cast("long").alias("n"))
    return c.select("conv_id", "turn").join(b, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("n", F.lit(0)).alias("score"))


@q("jn15_aligned_zip", "SELECT count(*) AS n, count(*) FILTER (a.c_custkey = b.c_custkey) AS aligned FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey")
def _(spark, d):
    """Arrays aligned by place become a join on the key, with the counts asserted equal."""
    a = t(spark, d, "customer").select("c_custkey")
    b = t(spark, d, "customer").select("c_custkey", F.lit(1).alias("here"))
    return a.join(b, "c_custkey", "left").agg(F.count("*").alias("n"), F.count("here").alias("aligned"))


@q("jn16_missing_predictions", f"SELECT c_custkey, round(coalesce(lat, 0), 6) AS lat, round(coalesce(lon, 0), 6) AS lon, lat IS NULL AS missing FROM customer LEFT JOIN (SELECT * FROM {points_sql('customer', 'c_custkey')} WHERE c_custkey % 6 <> 0) USING (c_custkey)")
def _(spark, d):
    p = points(spark, d, "customer", "c_custkey").where("c_custkey % 6 <> 0")
    return t(spark, d, "customer").select("c_custkey").join(p, "c_custkey", "left").select("c_custkey", r6(F.coalesce("lat", F.lit(0.0)), "lat"), r6(F.coalesce("lon", F.lit(0.0)), "lon"), F.col("lat").isNull().alias("missing"))


@q("jn17_member_expansion", f"SELECT o_custkey AS relation, round(min({lat_sql('l_partkey')}), 6) AS lat_min, round(max({lat_sql('l_partkey')}), 6) AS lat_max, round(min({lon_sql('l_partkey')}), 6) AS lon_min, round(max({lon_sql('l_partkey')}), 6) AS lon_max FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, d):
    """Relation to ways to boxes: ways are reduced to boxes before the second join."""
    way = t(spark, d, "lineitem").withColumn("a", geo.derived_lat("l_partkey")).withColumn("b", geo.derived_lon("l_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    return t(spark, d, "orders").join(way, "o_orderkey").groupBy(F.col("o_custkey").alias("relation")).agg(r6(F.min("a0"), "lat_min"), r6(F.max("a1"), "lat_max"), r6(F.min("b0"), "lon_min"), r6(F.max("b1"), "lon_max"))


@q("jn18_node_locations", f"SELECT l_orderkey AS way, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, count(*) AS nodes FROM lineitem JOIN {points_sql('part', 'p_partkey')} ON l_partkey = p_partkey GROUP BY 1")
def _(spark, d):
    node = points(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("l_partkey"), "lat")
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(node, "l_partkey").groupBy(F.col("l_orderkey").alias("way")).agg(r6(F.min("lat"), "lat_min"), r6(F.max("lat"), "lat_max"), F.count("*").alias("nodes"))


# -- aggregates ----------------------------------------------------------------------------------


@q("agg01_count_by_key", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@q("agg02_merged_counts", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    """Parts are counted each (on the task) and merged (after the shuffle) by the engine's two-phase aggregate."""
    li = t(spark, d, "lineitem").select("l_suppkey")
    return li.groupBy("l_suppkey").agg(F.count("*").alias("n"))


@q("agg03_distinct_count", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS authors FROM lineitem GROUP BY 1")
def _(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("authors"))


@q("agg04_arg_max_min", "SELECT c_nationkey, arg_max(c_custkey, c_acctbal * 1000 - c_custkey / CAST(100000 AS DOUBLE)) AS richest, arg_min(c_custkey, c_acctbal * 1000 + c_custkey / CAST(100000 AS DOUBLE)) AS poorest FROM customer GROUP BY 1")
def _(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("poorest"))


@q("agg05_best_first_kept", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def _(spark, d):
    best = F.min(F.struct((-F.col("l_discount")).alias("x"), "l_linenumber", "l_partkey")).alias("b")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(best).select("l_orderkey", "b.l_linenumber", "b.l_partkey")


@q("agg06_first_wins", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def _(spark, d):
    return t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@q("agg07_min_max_box", f"SELECT c_nationkey, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max FROM {points_sql('customer', 'c_custkey', '', 'c_nationkey')} GROUP BY 1")
def _(spark, d):
    c = points(spark, d, "customer", "c_custkey", "", "c_nationkey")
    return c.groupBy("c_nationkey").agg(r6(F.min("lat"), "lat_min"), r6(F.max("lat"), "lat_max"), r6(F.min("lon"), "lon_min"), r6(F.max("lon"), "lon_max"))


VOTE = f"(SELECT qid, author % 25 AS label, sum(w) / sum(sum(w)) OVER (PARTITION BY qid) AS share FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY qid)) / CAST(0.2 AS DOUBLE)) AS w FROM {POOL_SQL}) GROUP BY qid, author % 25)"


def votes(spark, d):
    p = pool(spark, d).withColumn("w", F.exp((F.col("score") - F.max("score").over(W.partitionBy("qid"))) / 0.2))
    by = p.groupBy("qid", (F.col("author") % 25).alias("label")).agg(F.sum("w").alias("w"))
    return by.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy("qid")))


@q("agg08_weighted_vote", f"SELECT qid, label, round(share, 6) AS share FROM {VOTE}")
def _(spark, d):
    return votes(spark, d).select("qid", "label", r6("share", "share"))


@q("agg09_rollup_region", f"SELECT qid, n_regionkey, round(sum(share), 6) AS share FROM {VOTE} JOIN nation ON label = n_nationkey GROUP BY ALL")
def _(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("label"), "n_regionkey")
    return votes(spark, d).join(F.broadcast(n), "label").groupBy("qid", "n_regionkey").agg(r6(F.sum("share"), "share"))


SOFT = f"(SELECT *, exp((score - max(score) OVER (PARTITION BY qid)) / CAST(0.2 AS DOUBLE)) / sum(exp(score / CAST(0.2 AS DOUBLE))) OVER (PARTITION BY qid) * exp(max(score) OVER (PARTITION BY qid) / CAST(0.2 AS DOUBLE)) AS w FROM {POOL_SQL})"


def soft(spark, d):
    by = W.partitionBy("qid")
    p = pool(spark, d).withColumn("e", F.exp((F.col("score") - F.max("score").over(by)) / 0.2))
    return p.withColumn("w", F.col("e") / F.sum("e").over(by)).drop("e")


def pool_pairs(p):
    """Every candidate with every candidate of its own query (pools are short lists)."""
    b = p.select("qid", F.col("pos").alias("pos2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("w").alias("w2"), F.col("score").alias("score2"))
    return p.join(b, "qid").withColumn("km", geo.haversine("lat", "lon", "lat2", "lon2"))


PAIRKM = hav_sql("a.lat", "a.lon", "b.lat", "b.lon")


@q("agg10_mass_within_radii", f"SELECT a.qid, a.pos, " + ", ".join(f"round(coalesce(sum(b.w) FILTER ({PAIRKM} < {k}), 0), 6) AS m{k}" for k in (1, 5, 25, 100)) + f" FROM {SOFT} a JOIN {SOFT} b USING (qid) GROUP BY ALL")
def _(spark, d):
    return pool_pairs(soft(spark, d)).groupBy("qid", "pos").agg(*[r6(F.sum(F.when(F.col("km") < k, F.col("w2")).otherwise(0.0)), f"m{k}") for k in (1, 5, 25, 100)])


@q("agg11_segment_softmax", f"SELECT qid, round(max(score) + ln(sum(exp(score - m))), 6) AS lse, count(*) AS n FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS m FROM {POOL_SQL}) GROUP BY qid")
def _(spark, d):
    p = pool(spark, d).withColumn("m", F.max("score").over(W.partitionBy("qid")))
    return p.groupBy("qid").agg(r6(F.max("score") + F.log(F.sum(F.exp(F.col("score") - F.col("m")))), "lse"), F.count("*").alias("n"))


@q("agg12_mean_median_quantiles", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(CAST(value > 10 AS INTEGER)), 6) AS share FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value"), "mean"), r6(F.median("value"), "med"), r6(F.percentile("value", 0.9), "p90"), r6(F.avg((F.col("value") > 10).cast("int")), "share"))


@q("agg13_conditional_counts", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS fixes, count(*) FILTER (event_type = 'error') AS breaks FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("fixes"), F.count_if(F.col("event_type") == "error").alias("breaks"))


@q("agg14_stratified_slices", "WITH s AS (SELECT c_acctbal > 0 AS ok, unnest(['all', c_mktsegment, 'r' || (c_nationkey % 5)]) AS slice FROM customer) SELECT slice, count(*) AS n, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy FROM s GROUP BY slice HAVING count(*) >= 30")
def _(spark, d):
    labels = F.array(F.lit("all"), F.col("c_mktsegment"), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")))
    s = t(spark, d, "customer").select((F.col("c_acctbal") > 0).cast("int").alias("ok"), F.explode(labels).alias("slice"))
    return s.groupBy("slice").agg(F.count("*").alias("n"), r6(F.avg("ok"), "accuracy")).where("n >= 30")


@q("agg15_pivot", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS HOUSEHOLD FROM customer GROUP BY 1")
def _(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "HOUSEHOLD"]).agg(F.count("c_custkey")).fillna(0)


@q("agg16_histogram", "SELECT CASE WHEN value < 1 THEN 0 WHEN value < 5 THEN 1 WHEN value < 25 THEN 2 WHEN value < 100 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    bucket = F.lit(0)
    for i, edge in enumerate((1, 5, 25, 100)):
        bucket = F.when(F.col("value") >= edge, i + 1).otherwise(bucket) if i == 0 else F.when(F.col("value") >= edge, F.lit(i + 1)).otherwise(bucket)
    return t(spark, d, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@q("agg17_most_common", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)) WHERE rn = 1")
def _(spark, d):
    c = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("event_type"))


XYZ = "sum(w * cos(radians(lat)) * cos(radians(lon))) AS x, sum(w * cos(radians(lat)) * sin(radians(lon))) AS y, sum(w * sin(radians(lat))) AS z"


@q("agg18_sphere_centroid", f"SELECT qid, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon FROM (SELECT qid, {XYZ} FROM {SOFT} GROUP BY qid)")
def _(spark, d):
    x, y, z = geo.unit_xyz("lat", "lon")
    s = soft(spark, d).groupBy("qid").agg(F.sum(F.col("w") * x).alias("x"), F.sum(F.col("w") * y).alias("y"), F.sum(F.col("w") * z).alias("z"), F.min_by("lat", "pos").alias("lat0"), F.min_by("lon", "pos").alias("lon0"))
    none = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) <= 1e-12
    return s.select("qid", r6(F.when(none, F.col("lat0")).otherwise(F.degrees(F.atan2("z", F.hypot("x", "y")))), "lat", 5), r6(F.when(none, F.col("lon0")).otherwise(F.degrees(F.atan2("y", "x"))), "lon", 5))


@q("agg19_median_centre", f"SELECT c_nationkey, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon FROM {points_sql('customer', 'c_custkey', '', 'c_nationkey')} GROUP BY 1")
def _(spark, d):
    return points(spark, d, "customer", "c_custkey", "", "c_nationkey").groupBy("c_nationkey").agg(r6(F.median("lat"), "lat"), r6(F.median("lon"), "lon"))


@q("agg20_vocabulary", "SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS id FROM documents GROUP BY source")
def _(spark, d):
    """Dense ids by first appearance; the window runs over distinct values only."""
    v = t(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return v.select("source", (F.row_number().over(W.orderBy("first")) - 1).cast("long").alias("id"))


@q("agg21_set_aggregation", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def _(spark, d):
    kinds = F.array_sort(F.collect_set("event_type"))
    return t(spark, d, "events").groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"), F.size(kinds).cast("long").alias("n"))


@q("agg22_ordered_distinct", "SELECT qid, array_to_string(list(label ORDER BY first), ',') AS labels FROM (SELECT qid, author % 5 AS label, min(pos) AS first FROM " + POOL_SQL + " GROUP BY ALL) GROUP BY qid")
def _(spark, d):
    seen = F.array_sort(F.collect_list(F.struct("pos", (F.col("author") % 5).cast("string").alias("label"))))
    return pool(spark, d).groupBy("qid").agg(F.array_join(F.array_distinct(F.transform(seen, lambda x: x.label)), ",").alias("labels"))


@q("agg23_group_shares", "SELECT c_nationkey, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 6) AS share, round(avg(CAST(c_acctbal < 0 AS INTEGER)) / (SELECT avg(CAST(c_acctbal < 0 AS INTEGER)) FROM customer), 6) AS ratio FROM customer GROUP BY 1 HAVING count(*) >= 55")
def _(spark, d):
    c = t(spark, d, "customer").withColumn("bad", (F.col("c_acctbal") < 0).cast("int"))
    whole = c.agg(F.count("*").alias("everyone"), F.avg("bad").alias("rate"))
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg("bad").alias("m")).where("n >= 55").join(F.broadcast(whole)).select("c_nationkey", "n", r6(F.col("n") / F.col("everyone"), "share"), r6(F.col("m") / F.col("rate"), "ratio"))


@q("agg24_two_order_debias", "SELECT conv_id, round(avg(CASE WHEN turn % 2 = 1 THEN 1 - p ELSE p END), 6) AS p FROM (SELECT conv_id, turn, (length(text) % 100) / CAST(100 AS DOUBLE) AS p FROM conversations WHERE turn < 2) GROUP BY 1 HAVING count(*) = 2")
def _(spark, d):
    p = (F.length("text") % 100) / 100.0
    c = t(spark, d, "conversations").where("turn < 2").select("conv_id", F.when(F.col("turn") % 2 == 1, 1 - p).otherwise(p).alias("p"))
    return c.groupBy("conv_id").agg(r6(F.avg("p"), "p"), F.count("*").alias("n")).where("n = 2").drop("n")


@q("agg25_accuracy_bands", "SELECT band, count(*) AS n, round(avg(CAST(event_type = 'purchase' AS INTEGER)), 6) AS hit FROM events JOIN (VALUES (0, 0, 5), (1, 5, 10), (2, 10, 20), (3, 20, 1000)) b(band, lo, hi) ON value >= lo AND value < hi GROUP BY 1")
def _(spark, d):
    """Bands by a chain of edges instead of a range join."""
    band = F.when(F.col("value") < 5, 0).when(F.col("value") < 10, 1).when(F.col("value") < 20, 2).when(F.col("value") < 1000, 3)
    return t(spark, d, "events").where("value >= 0 and value < 1000").groupBy(band.alias("band")).agg(F.count("*").alias("n"), r6(F.avg((F.col("event_type") == "purchase").cast("int")), "hit"))


# -- windows -------------------------------------------------------------------------------------


@q("win01_rank_in_query", f"SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM {POOL_SQL}")
def _(spark, d):
    return pool(spark, d).select("qid", "pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "pos")).cast("long").alias("rank"))


@q("win02_support_rank", f"SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY author DESC, pos) - 1 AS rank FROM {POOL_SQL}")
def _(spark, d):
    return pool(spark, d).select("qid", "pos", (F.row_number().over(W.partitionBy("qid").orderBy(F.desc("author"), "pos")) - 1).cast("long").alias("rank"))


@q("win03_relative_to_group", f"SELECT qid, pos, round(score - max(score) OVER (PARTITION BY qid), 6) AS gap, round(score / sum(score) OVER (PARTITION BY qid), 6) AS share FROM {POOL_SQL}")
def _(spark, d):
    by = W.partitionBy("qid")
    return pool(spark, d).select("qid", "pos", r6(F.col("score") - F.max("score").over(by), "gap"), r6(F.col("score") / F.sum("score").over(by), "share"))


@q("win04_margin_top2", f"SELECT qid, round(max(score) FILTER (pos = 1) - max(score) FILTER (pos = 2), 6) AS margin FROM {POOL_SQL} WHERE pos <= 2 GROUP BY qid")
def _(spark, d):
    s = lambda k: F.max(F.when(F.col("pos") == k, F.col("score")))
    return pool(spark, d).where("pos <= 2").groupBy("qid").agg(r6(s(1) - s(2), "margin"))


@q("win05_top3_mean", f"SELECT qid, round(avg(score), 6) AS m FROM {POOL_SQL} WHERE pos <= 3 GROUP BY qid")
def _(spark, d):
    return pool(spark, d).where("pos <= 3").groupBy("qid").agg(r6(F.avg("score"), "m"))


@q("win06_slot_number", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS slot FROM conversations")
def _(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("slot"))


@q("win07_prefix_precision", f"SELECT qid, pos, round(sum(CAST(author % 3 = 0 AS INTEGER)) OVER (PARTITION BY qid ORDER BY pos) / CAST(pos AS DOUBLE), 6) AS precision FROM {POOL_SQL}")
def _(spark, d):
    by = W.partitionBy("qid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return pool(spark, d).select("qid", "pos", r6(F.sum((F.col("author") % 3 == 0).cast("int")).over(by) / F.col("pos"), "precision"))


@q("win08_ordinal_auc", "SELECT round((sum(rn) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / CAST(2 AS DOUBLE)) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM (SELECT quality, row_number() OVER (ORDER BY n_chars, doc_id) AS rn FROM labels JOIN documents USING (doc_id))")
def _(spark, d):
    """Counts of negatives below each positive; no window over all rows."""
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.ordinal_auc(x, "n_chars", "quality", "doc_id").select(r6("auc", "auc"))


@q("win09_budget_prefix", f"SELECT qid, k, round(sum(w) FILTER (rn <= k), 6) AS mass FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, pos) AS rn FROM {SOFT}), (VALUES (1), (2), (4)) b(k) GROUP BY ALL")
def _(spark, d):
    ranked = soft(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("w"), "pos")))
    return ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4)]))).where("rn <= k").groupBy("qid", "k").agg(r6(F.sum("w"), "mass"))


@q("win10_cumulative_offsets", "SELECT source, CAST(sum(n) OVER (ORDER BY source) - n AS BIGINT) AS start FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def _(spark, d):
    c = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return c.select("source", (F.sum("n").over(W.orderBy("source").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))


@q("win11_cumulative_2d", f"WITH g AS (SELECT CAST(floor((lat + 90) / 20) AS INTEGER) AS r, CAST(floor((lon + 180) / 30) AS INTEGER) AS c FROM {points_sql('customer', 'c_custkey')}) SELECT a.r, b.c, (SELECT count(*) FROM g WHERE g.r <= a.r AND g.c <= b.c) AS n FROM (SELECT DISTINCT r FROM g) a, (SELECT DISTINCT c FROM g) b")
def _(spark, d):
    g = points(spark, d, "customer", "c_custkey").groupBy(geo.cell("lat", 20.0, -90.0).alias("r"), geo.cell("lon", 30.0, -180.0).alias("c")).agg(F.count("*").alias("n"))
    grid = g.select("r").distinct().join(g.select("c").distinct()).join(g, ["r", "c"], "left").fillna(0, ["n"])  # cells of a fixed raster
    up = grid.withColumn("n", F.sum("n").over(W.partitionBy("c").orderBy("r")))
    return up.withColumn("n", F.sum("n").over(W.partitionBy("r").orderBy("c")))


@q("win12_cap_per_key", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('cap:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def _(spark, d):
    return selection.cap_per_key(t(spark, d, "documents").select("doc_id", "source"), "source", 5, "cap", "doc_id").select("doc_id")


@q("win13_minus_best_other", f"SELECT qid, pos, round(score - coalesce(CASE WHEN rn = 1 THEN s2 ELSE s1 END, score), 6) AS gap FROM (SELECT *, row_number() OVER w AS rn, first_value(score) OVER w AS s1, nth_value(score, 2) OVER (PARTITION BY qid ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s2 FROM {POOL_SQL} WINDOW w AS (PARTITION BY qid ORDER BY score DESC, pos))")
def _(spark, d):
    by = W.partitionBy("qid").orderBy(F.desc("score"), "pos")
    full = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    other = F.when(F.row_number().over(by) == 1, F.nth_value("score", 2).over(full)).otherwise(F.first("score").over(full))
    return pool(spark, d).select("qid", "pos", r6(F.col("score") - F.coalesce(other, F.col("score")), "gap"))


@q("win14_distance_rank_prefix", f"SELECT c_nationkey, " + ", ".join(f"round(max(c_acctbal) FILTER (rn <= {k}), 2) AS best{k}" for k in (10, 25, 50)) + f" FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {hav_sql('lat', 'lon', '0', '0')}, c_custkey) AS rn FROM {points_sql('customer', 'c_custkey', '', 'c_nationkey, c_acctbal')}) GROUP BY 1")
def _(spark, d):
    c = points(spark, d, "customer", "c_custkey", "", "c_nationkey", "c_acctbal").withColumn("km", geo.haversine("lat", "lon", 0.0, 0.0))
    r = c.withColumn("rn", F.row_number().over(W.partitionBy("c_nationkey").orderBy("km", "c_custkey"))).where("rn <= 50")
    return r.groupBy("c_nationkey").agg(*[r6(F.max(F.when(F.col("rn") <= k, F.col("c_acctbal"))), f"best{k}", 2) for k in (10, 25, 50)])


# -- sorts, limits, sets, samples ----------------------------------------------------------------


@q("srt01_multi_key_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_type = 'PROMO' DESC, p_size, p_retailprice DESC, p_partkey) AS place FROM part")
def _(spark, d):
    """Every row with its place."""
    p = t(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return ordering.placed(p, F.desc(F.col("p_type") == "PROMO"), "p_size", F.desc("p_retailprice"), "p_partkey").select("p_partkey", "place")


@q("srt02_stable_sort", "SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) AS place FROM documents")
def _(spark, d):
    """Every row with its place."""
    return ordering.placed(t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "place")


@q("srt03_spatial_order", f"SELECT c_custkey, CAST(floor((lat + 90) / 2) * 180 + floor((lon + 180) / 2) AS BIGINT) AS cell FROM {points_sql('customer', 'c_custkey')}")
def _(spark, d):
    """Rows clustered by cell: ranges of cells to partitions, sorted within."""
    c = points(spark, d, "customer", "c_custkey").withColumn("cell", (F.floor((F.col("lat") + 90) / 2) * 180 + F.floor((F.col("lon") + 180) / 2)).cast("long"))
    return c.repartitionByRange("cell", "c_custkey").sortWithinPartitions("cell", "c_custkey").select("c_custkey", "cell")


@q("srt04_retrieval_order", "SELECT doc_id, row_number() OVER (ORDER BY greatest(a, b) DESC NULLS LAST, doc_id) AS place FROM (SELECT doc_id, CASE WHEN quality = 1 THEN doc_id % 97 END AS a, CASE WHEN toxic = 1 THEN doc_id % 89 END AS b FROM labels)")
def _(spark, d):
    """Every row with its place, those that no modality found last."""
    a, b = F.when(F.col("quality") == 1, F.col("doc_id") % 97), F.when(F.col("toxic") == 1, F.col("doc_id") % 89)
    rows = t(spark, d, "labels").select("doc_id", F.greatest(a, b).alias("best"))
    return ordering.placed(rows, F.desc_nulls_last("best"), "doc_id").select("doc_id", "place")


@q("lim01_cap_per_source", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20")
def _(spark, d):
    return t(spark, d, "documents").withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("rn <= 20").select("doc_id")


@q("lim02_top_merged", "SELECT p_name, min(p_partkey) AS first FROM part GROUP BY p_name ORDER BY 2 LIMIT 5")
def _(spark, d):
    return t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first")).orderBy("first").limit(5)


@q("set01_union_all", "SELECT s_suppkey AS id, 'supplier' AS src FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer")
def _(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("src")).unionByName(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("src")))


@q("set02_union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def _(spark, d):
    return t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(t(spark, d, "customer").select("c_nationkey")).distinct()


@q("set03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id").subtract(t(spark, d, "labels").select("doc_id"))


@q("set04_intersection_count", "SELECT count(*) AS both FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(spark, d):
    e = t(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id")).agg(F.count("*").alias("both"))


@q("set05_interleaved_concat", "SELECT c_custkey, row_number() OVER (ORDER BY (rn - 1) // 32, w, rn) - 1 AS place FROM (SELECT c_custkey, c_custkey % 4 AS w, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) AS rn FROM customer WHERE c_custkey <> 457)")
def _(spark, d):
    """Streams by row mod 4, batches of 32 in turn; a place follows from counts, without a global sort: earlier batches of all streams, then earlier streams of this batch."""
    c = t(spark, d, "customer").where("c_custkey <> 457").select("c_custkey", (F.col("c_custkey") % 4).alias("w"))
    size = {r["w"]: r["n"] for r in c.groupBy("w").agg(F.count("*").alias("n")).collect()}  # four numbers
    x = c.withColumn("rn", F.row_number().over(W.partitionBy("w").orderBy("c_custkey")) - 1).withColumn("b", F.floor(F.col("rn") / 32))
    place = F.col("rn") % 32
    for w, n in size.items():
        done = F.least(F.lit(n), F.col("b") * 32)
        here = F.least(F.lit(n), (F.col("b") + 1) * 32)
        place = place + F.when(F.lit(w) < F.col("w"), here).otherwise(done)
    return x.select("c_custkey", place.cast("long").alias("place"))


@q("smp01_md5_sample", "SELECT doc_id FROM documents ORDER BY md5('s1:' || doc_id) LIMIT 50")
def _(spark, d):
    return t(spark, d, "documents").orderBy(F.md5(F.concat(F.lit("s1:"), F.col("doc_id").cast("string")))).limit(50).select("doc_id")


@q("smp02_stable_subset", "SELECT doc_id FROM documents ORDER BY sha256('salt:' || doc_id) LIMIT 64")
def _(spark, d):
    return t(spark, d, "documents").orderBy(hashing.order("salt", "doc_id")).limit(64).select("doc_id")


@q("smp03_random_without_replacement", "SELECT c_custkey FROM customer ORDER BY sha256('seed7:' || c_custkey) LIMIT 100")
def _(spark, d):
    return t(spark, d, "customer").orderBy(hashing.order("seed7", "c_custkey")).limit(100).select("c_custkey")


@q("smp04_stratified_sample", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 2 ORDER BY sha256('strat:' || c_custkey)) AS rn FROM customer) WHERE rn <= 10")
def _(spark, d):
    by = W.partitionBy("c_mktsegment", F.col("c_nationkey") % 2).orderBy(hashing.order("strat", "c_custkey"))
    return t(spark, d, "customer").withColumn("rn", F.row_number().over(by)).where("rn <= 10").select("c_custkey")


@q("smp05_class_downsample", "SELECT doc_id, 1 AS copy FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('neg:' || doc_id)) AS rn FROM labels WHERE quality = 1) WHERE rn <= 60 UNION ALL SELECT doc_id, unnest([1, 2, 3]) FROM labels WHERE quality = 0")
def _(spark, d):
    x = t(spark, d, "labels").select("doc_id", "quality")
    many = x.where("quality = 1").orderBy(hashing.order("neg", "doc_id")).limit(60).select("doc_id", F.lit(1).alias("copy"))
    few = x.where("quality = 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    return many.union(few)


@q("smp06_source_mixing", "SELECT source, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS proportional, round(1 / CAST(count(*) OVER () AS DOUBLE), 6) AS uniform FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def _(spark, d):
    c = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    whole = c.agg(F.sum("n").alias("rows"), F.count("*").alias("k"))
    return c.join(F.broadcast(whole)).select("source", r6(F.col("n") / F.col("rows"), "proportional"), r6(1 / F.col("k"), "uniform"))


@q("smp07_derangement", "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('der:' || c_custkey)) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT a.c_custkey, b.c_custkey AS other FROM r a JOIN r b ON a.c_nationkey = b.c_nationkey AND b.rn = a.rn % a.n + 1")
def _(spark, d):
    by = W.partitionBy("c_nationkey")
    r = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.row_number().over(by.orderBy(hashing.order("der", "c_custkey"))).alias("rn"), F.count("*").over(by).alias("n"))
    b = r.select("c_nationkey", F.col("c_custkey").alias("other"), F.col("rn").alias("to"))
    return r.withColumn("to", F.col("rn") % F.col("n") + 1).join(b, ["c_nationkey", "to"]).select("c_custkey", "other")


NEG = f"(SELECT a.c_custkey AS qid, s.s_suppkey, {hav_sql('a.lat', 'a.lon', 's.rlat', 's.rlon')} AS km FROM (SELECT * FROM {points_sql('customer', 'c_custkey')} WHERE c_custkey % 100 = 0) a, {points_sql('supplier', 's_suppkey', 'r')} s)"


#: One in so many candidates is looked at first.
SHARE = 16


@q("smp08_negative_sampling", f"SELECT qid, kind, s_suppkey FROM (SELECT qid, s_suppkey, CASE WHEN km <= 2000 THEN 'hard' ELSE 'global' END AS kind, row_number() OVER (PARTITION BY qid, km <= 2000 ORDER BY sha256('neg:' || qid || ':' || s_suppkey)) AS rn FROM {NEG} WHERE km > 300) WHERE rn <= 2")
def _(spark, d):
    c = points(spark, d, "customer", "c_custkey").where("c_custkey % 100 = 0").withColumnRenamed("c_custkey", "qid")
    s = points(spark, d, "supplier", "s_suppkey", "r").repartition(max(32, 4 * spark.sparkContext.defaultParallelism), "s_suppkey")  # one file would be one task
    # A stated query set (ids divisible by 100) against all rows: every candidate is met once for the global stratum.
    def met(s, c):
        pairs = s.join(F.broadcast(c), F.lit(True)).withColumn("km", geo.haversine("lat", "lon", "rlat", "rlon")).where("km > 300")
        digest = F.sha2(F.concat_ws(":", F.lit("neg"), F.col("qid").cast("string"), F.col("s_suppkey").cast("string")), 256)
        return pairs.withColumn("kind", F.when(F.col("km") <= 2000, "hard").otherwise("global")).withColumn("at", digest)

    # The second least digest of a part of the candidates bounds that of all: of every pair that is met, only what
    # reaches the bound is ranked.  Where the part has fewer than two, there is no bound.
    by = W.partitionBy("qid", "kind").orderBy("at")
    few = met(s.where(F.pmod(F.xxhash64("s_suppkey"), F.lit(SHARE)) == 0), c).withColumn("rn", F.row_number().over(by)).where("rn = 2")
    bounds = written(few.groupBy("qid").agg(*[F.max(F.when(F.col("kind") == k, F.col("at"))).alias(k) for k in ("hard", "global")]), "bounds")
    bound = F.when(F.col("kind") == "hard", F.col("hard")).otherwise(F.col("global"))
    left = met(s, c.join(bounds, "qid", "left")).where(bound.isNull() | (F.col("at") <= bound))
    return left.withColumn("rn", F.row_number().over(by)).where("rn <= 2").select("qid", "kind", "s_suppkey")
