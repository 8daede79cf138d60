"""Strings, full text, JSON, arrays, maps, times and hashes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import hashing, text
from stratalens.operators import ordering, postings, selection
from stratalens.plans.base import q, r6, t
from stratalens.plans.rel_queries import MD5, tags

N = "trim(regexp_replace(strip_accents(replace(lower({c}), 'ß', 'ss')), '[^0-9a-z]+', ' ', 'g'))"
NDOC = f"(SELECT doc_id, lang, source, n_chars, {N.format(c='text')} AS norm FROM documents)"


def ndocs(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", text.norm_latin(F.col("text")).alias("norm"))


def index(spark, d, phrases=None):
    """Postings of all tokens, or of those only that the phrases have."""
    return postings.postings(ndocs(spark, d), "doc_id", "norm", phrases)


@q("str01_norm", f"SELECT doc_id, md5({N.format(c='text')}) AS digest FROM documents")
def _(spark, d):
    """The whole normalisation (compatibility forms, case folding, marks) in Arrow batches, once at ingest."""
    return t(spark, d, "documents").select("doc_id", F.md5(text.norm(F.col("text"))).alias("digest"))


@q("str02_ascii_label", "SELECT p_partkey, regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]', '', 'g') AS label FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", text.ascii_label(F.concat_ws(" ", "p_brand", "p_name")).alias("label"))


@q("str03_label_right", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type = p_name OR contains(lower(p_brand) || 'x', 'brand') END AS ok FROM part")
def _(spark, d):
    truth = F.when(F.col("p_partkey") % 10 != 0, F.lit("Brand"))
    return t(spark, d, "part").select("p_partkey", text.label_right(F.col("p_brand"), truth).alias("ok"))


#: The host is what stands before the first of / ? # : once the scheme is off.
HOST_LABELS = "(SELECT page_id, CASE WHEN len(l) > 2 AND regexp_full_match(l[1], 'www[0-9]?') THEN l[2:] ELSE l END AS labels FROM (SELECT page_id, string_split(regexp_split_to_array(regexp_replace(lower(trim(url)), '^[a-z][-+.a-z0-9]*://', ''), '[/?#:]')[1], '.') AS l FROM pages))"


@q("str04_domain", f"SELECT page_id, array_to_string(labels[greatest(1, len(labels) - 1):], '.') AS domain FROM {HOST_LABELS}")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@q("str05_phone_digits", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+4420' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 1 THEN '+3312' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS digits FROM customer")
def _(spark, d):
    tail, k = F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("+44 (20) "), tail)).when(k == 1, F.concat(F.lit("Tel. 0033-12-"), tail)).otherwise("2019")
    return t(spark, d, "customer").select("c_custkey", text.phone(raw).alias("digits"))


@q("str06_phone_prefix", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'GB' ELSE 'LU' END AS cc FROM customer")
def _(spark, d):
    """The longest of the 4- to 1-digit prefixes that a table knows."""
    codes = spark.createDataFrame([("44", "GB"), ("4", "??"), ("352", "LU"), ("35", "??")], "prefix string, cc string")
    number = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("44"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("352"), F.col("c_custkey").cast("string")))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substr(number, F.lit(1), n))).alias("prefix")
    hit = t(spark, d, "customer").select("c_custkey", cut).join(F.broadcast(codes), "prefix")
    return hit.groupBy("c_custkey").agg(F.max_by("cc", F.length("prefix")).alias("cc"))


@q("str07_query_kind", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'phone' WHEN page_id % 3 = 1 THEN 'domain' ELSE 'name' END AS kind FROM pages")
def _(spark, d):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("+44 20 7946 0"), F.col("page_id").cast("string"))).when(k == 1, F.col("url")).otherwise("Old Town Hall")
    kind = F.when(text.phone(F.col("raw")).isNotNull(), "phone").when(text.domain(F.col("raw")).isNotNull(), "domain").otherwise("name")
    return t(spark, d, "pages").select("page_id", raw.alias("raw")).select("page_id", kind.alias("kind"))


@q("str08_word_spans", "WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS w FROM part), s AS (SELECT p_partkey, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS span FROM w) SELECT p_partkey, span FROM s WHERE span NOT IN ('small', 'large')")
def _(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    spans = t(spark, d, "part").select("p_partkey", F.explode(text.grams(words, 3)).alias("span"))
    return spans.where(~F.col("span").isin("small", "large"))


PHRASES = "(SELECT item_id AS pid, trim(" + N.format(c="text") + ") AS phrase FROM benchmark UNION ALL SELECT -1, 'the')"


def phrases(spark, d):
    """Every benchmark text as a phrase, whole, and a phrase of one word."""
    said = t(spark, d, "benchmark").select(F.col("item_id").alias("pid"), text.norm_latin(F.col("text")).alias("phrase"))
    return said.union(spark.createDataFrame([(-1, "the")], "pid long, phrase string")).where("phrase <> ''")


@q("str09_multi_phrase_match", f"SELECT pid, count(*) AS n FROM {PHRASES}, {NDOC} WHERE phrase <> '' AND contains(' ' || norm || ' ', ' ' || phrase || ' ') GROUP BY pid")
def _(spark, d):
    """All phrases in one pass over the documents, each matched whole."""
    return postings.count_phrases(ndocs(spark, d), phrases(spark, d), "norm")


#: Units numbered; a passage starts where the open one and the next unit are too long together.
PASSAGES = r"""WITH RECURSIVE l AS (SELECT doc_id, text, regexp_split_to_array(text, '\n+') AS lines FROM documents WHERE text IS NOT NULL),
u AS MATERIALIZED (SELECT doc_id, list_filter(list_transform(CASE WHEN len(lines) = 1 AND length(text) > 700 THEN string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE lines END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS units FROM l),
w(doc_id, i, n, room) AS (SELECT doc_id, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(length(units[1]) AS BIGINT) FROM u WHERE len(units) > 0
 UNION ALL SELECT w.doc_id, i + 1, CASE WHEN room + length(units[i + 1]) > 700 THEN n + 1 ELSE n END, CASE WHEN room + length(units[i + 1]) > 700 THEN length(units[i + 1]) ELSE room + 1 + length(units[i + 1]) END FROM w JOIN u ON u.doc_id = w.doc_id WHERE i < len(units))
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(length(passage) AS INTEGER) AS chars, md5(passage) AS digest FROM (SELECT w.doc_id, n, string_agg(units[i], chr(10) ORDER BY i) AS passage FROM w JOIN u ON u.doc_id = w.doc_id GROUP BY ALL)"""


@q("str10_passages", PASSAGES)
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(text.passages(F.col("text"))).alias("n", "passage")).select("doc_id", "n", F.length("passage").alias("chars"), F.md5("passage").alias("digest"))


@q("str11_snippet", "SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, s + 1, 200), '\\s+', ' ', 'g')) || CASE WHEN s + 200 < length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, text, greatest(0, CASE WHEN instr(lower(text), 'the') > 0 THEN instr(lower(text), 'the') ELSE 1 END - 1 - 66) AS s FROM documents)")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), F.array(F.lit("the"))).alias("snippet"))


@q("str12_strip_wikitext", "SELECT p_partkey, p_name || ' is a ' || p_type || ' of ' || p_brand || '.' AS plain FROM part")
def _(spark, d):
    raw = F.concat(F.lit("{{Info|{{x|{{y}}}}}}'''"), "p_name", F.lit("''' is a [[Kind|"), "p_type", F.lit("]]<ref name=a/> of [["), "p_brand", F.lit("]].<!-- note -->"))
    return t(spark, d, "part").select("p_partkey", text.strip_wikitext(raw).alias("plain"))


@q("str13_first_sentence", "SELECT doc_id, CASE WHEN s <> '' THEN s ELSE substr(text, 1, 300) END AS lead FROM (SELECT doc_id, text, regexp_extract(text, '(?s)^(.{60,}?[.!?])(?:\\s|$)', 1) AS s FROM documents)")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("lead"))


@q("str14_suffix_strip", "SELECT p_partkey, p_name AS name FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", F.regexp_replace(F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")")), r"\s*\(.*\)$", "").alias("name"))


@q("str15_html_strip", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("digest"))


@q("str16_url_decode", "SELECT p_partkey, left(replace(p_name || ', ' || p_brand, ',', ' '), 300) AS title FROM part")
def _(spark, d):
    raw = F.url_encode(F.concat("p_name", F.lit(", "), "p_brand"))
    return t(spark, d, "part").select("p_partkey", F.left(F.translate(F.try_url_decode(raw), ",", " "), F.lit(300)).alias("title"))


@q("str17_last_latlon", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 90 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS lat, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE -CAST(c_custkey % 170 AS DOUBLE) END AS lon FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, "no idea").otherwise(F.concat(F.lit("first 1.0, 2.0 then "), (k % 90).cast("string"), F.lit(".5, -"), (k % 170).cast("string")))
    return t(spark, d, "customer").select("c_custkey", text.last_latlon(said).alias("p")).select("c_custkey", "p.lat", "p.lon")


@q("str18_photo_id", "SELECT o_orderkey, o_custkey AS first, o_orderkey AS last FROM orders")
def _(spark, d):
    name = F.concat_ws("_", F.col("o_custkey").cast("string"), F.lit("x"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")))
    stem = F.split(F.regexp_extract(name, r"^(.*)\.[a-z]+$", 1), "_")
    return t(spark, d, "orders").select("o_orderkey", F.element_at(stem, 1).cast("long").alias("first"), F.element_at(stem, -1).cast("long").alias("last"))


@q("str19_cue_parsing", "SELECT doc_id, lang || ':script' AS cue FROM documents UNION ALL SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE 'spa' END || ':iso' FROM documents")
def _(spark, d):
    iso = F.create_map(*[F.lit(x) for x in ("en", "eng", "de", "deu", "fr", "fra", "es", "spa")])
    raw = F.concat(F.col("lang"), F.lit(":script;"), F.element_at(iso, F.substring("lang", 1, 2)), F.lit(":iso"))
    return t(spark, d, "documents").select("doc_id", F.explode(F.split(raw, ";")).alias("cue"))


@q("str20_cue_votes", "SELECT c_custkey, sum(CASE WHEN n.n_regionkey = 1 THEN 1 ELSE 0 END) - sum(CASE WHEN n.n_regionkey = 2 THEN 1 ELSE 0 END) AS votes FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = (o_orderkey % 25) GROUP BY 1")
def _(spark, d):
    facts = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("cue"), "n_regionkey")
    cues = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 25).alias("cue"))
    fits = lambda r: F.count_if(F.col("n_regionkey") == r)
    return cues.join(F.broadcast(facts), "cue").groupBy("c_custkey").agg((fits(1) - fits(2)).alias("votes"))


@q("str21_result_text", "SELECT l_orderkey, printf('%d. part %d (%.2f)', l_linenumber, l_partkey, l_extendedprice) AS line FROM lineitem WHERE l_linenumber = 1")
def _(spark, d):
    return t(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.format_string("%d. part %d (%.2f)", "l_linenumber", "l_partkey", "l_extendedprice").alias("line"))


@q("str22_name_chain", "SELECT c_custkey, r_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' > ' || replace(n_name, '>', '-') || CASE WHEN c_custkey % 3 = 1 THEN '' ELSE ' > ' || c_name END END AS chain FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    """Coarse to fine, cut at the first missing level."""
    n = t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    k = F.col("c_custkey") % 3
    levels = F.array(F.col("r_name"), F.when(k != 0, F.regexp_replace("n_name", ">", "-")), F.when(k == 2, F.col("c_name")))
    upto = F.coalesce(F.array_position(F.transform(levels, lambda x: x.isNull()), True), F.lit(0))
    kept = F.when(upto > 0, F.slice(levels, F.lit(1), (upto - 1).cast("int"))).otherwise(levels)
    return t(spark, d, "customer").join(F.broadcast(n), "c_nationkey").join(F.broadcast(r), "n_regionkey").select("c_custkey", F.array_join(kept, " > ").alias("chain"))


# -- full text -----------------------------------------------------------------------------------

TOK = f"(SELECT doc_id AS doc, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM {NDOC}))"


@q("txt01_postings", f"SELECT token, count(*) AS n, count(DISTINCT doc) AS docs FROM {TOK} GROUP BY token")
def _(spark, d):
    return index(spark, d).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


SAID = "(VALUES (1, 'of the'), (2, 'in that and'), (3, 'the of a'), (4, 'zz yy'), (5, 'with for zzz'), (6, 'the the')) p(pid, phrase)"
SAY = [(1, "of the"), (2, "in that and"), (3, "the of a"), (4, "zz yy"), (5, "with for zzz"), (6, "the the")]


def said(spark):
    return spark.createDataFrame(SAY, "pid int, phrase string")


EXACT = f"SELECT DISTINCT pid, doc_id AS doc FROM {SAID}, {NDOC} WHERE contains(' ' || norm || ' ', ' ' || phrase || ' ')"


@q("txt02_phrase_match", EXACT)
def _(spark, d):
    return postings.phrase_matches(index(spark, d, said(spark)), said(spark)).select("pid", "doc").distinct()


@q("txt03_relaxation_tiers", f"""WITH e AS ({EXACT}), w AS (SELECT DISTINCT pid, unnest(string_split(phrase, ' ')) AS token FROM {SAID}), n AS (SELECT pid, count(*) AS n FROM w GROUP BY 1),
h AS (SELECT pid, doc, count(*) AS m FROM (SELECT DISTINCT doc, token FROM {TOK}) JOIN w USING (token) GROUP BY ALL),
a AS (SELECT pid, doc, 1 AS tier FROM e UNION ALL SELECT h.pid, doc, 2 FROM h JOIN n ON h.pid = n.pid WHERE m = n AND n >= 2 UNION ALL SELECT h.pid, doc, 3 FROM h JOIN n ON h.pid = n.pid WHERE n >= 3),
b AS (SELECT pid, doc, min(tier) AS tier FROM a GROUP BY ALL)
SELECT pid, doc, tier FROM b WHERE tier = (SELECT min(tier) FROM b c WHERE c.pid = b.pid)""")
def _(spark, d):
    return postings.relaxed(index(spark, d, said(spark)), said(spark))


BM = f"""(WITH x AS {TOK}, dl AS (SELECT doc, count(*) AS dl FROM x GROUP BY 1), s AS (SELECT count(*) AS N, avg(dl) AS a FROM dl), w AS (SELECT DISTINCT pid, unnest(string_split(phrase, ' ')) AS token FROM {SAID}),
tf AS (SELECT token, doc, count(*) AS tf FROM x WHERE token IN (SELECT token FROM w) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1)
SELECT pid, tf.doc, sum(greatest(CAST(0.000001 AS DOUBLE), ln((N - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)))) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / a))) AS score
FROM tf JOIN df ON tf.token = df.token JOIN dl ON dl.doc = tf.doc CROSS JOIN s JOIN w ON w.token = tf.token GROUP BY pid, tf.doc)"""


@q("txt04_bm25", f"SELECT pid, doc, round(score, 5) AS score FROM {BM}")
def _(spark, d):
    return postings.bm25(ndocs(spark, d), said(spark), "doc_id", "norm").select("pid", "doc", r6("score", "score", 5))


RANK = f"(SELECT pid, doc, source, -score - CASE WHEN source = 'src1' THEN 8 WHEN starts_with(source, 'src1') THEN 3 ELSE 0 END - ln(1 + n_chars / CAST(1000 AS DOUBLE)) AS r FROM {BM} JOIN documents ON doc = doc_id)"


def ranked(spark, d):
    hits = postings.bm25(ndocs(spark, d), said(spark), "doc_id", "norm").join(t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", "n_chars"), "doc")
    return hits.select("pid", "doc", "source", postings.custom_rank(F.col("score"), F.col("source"), F.lit("src1"), F.col("n_chars")).alias("r"))


@q("txt05_custom_rank", f"SELECT pid, doc, round(r, 5) AS r FROM {RANK}")
def _(spark, d):
    return ranked(spark, d).select("pid", "doc", r6("r", "r", 5))


@q("txt06_best_per_page", f"SELECT pid, source, round(min(r), 5) AS r FROM {RANK} GROUP BY ALL")
def _(spark, d):
    return ranked(spark, d).groupBy("pid", "source").agg(r6(F.min("r"), "r", 5))


@q("txt07_translation_dedup", "SELECT doc_id FROM (SELECT doc_id, lang, first_value(lang) OVER (PARTITION BY doc_id // 3 ORDER BY n_chars, doc_id) AS f FROM documents) WHERE lang = f")
def _(spark, d):
    x = t(spark, d, "documents").withColumn("name", F.floor(F.col("doc_id") / 3))
    return postings.first_language_wins(x, "name", "lang", "n_chars", "doc_id").select("doc_id")


#: Phrases of common words and whole benchmark texts, in half of the sources.
RARE = 40
PH8 = f"(SELECT pid, phrase FROM {SAID} UNION ALL SELECT item_id + 100, trim({N.format(c='text')}) FROM benchmark)"
RARE_SQL = f"""WITH ph AS MATERIALIZED {PH8}, e AS (SELECT DISTINCT pid, doc_id AS doc, source FROM ph, {NDOC} WHERE phrase <> '' AND contains(' ' || norm || ' ', ' ' || phrase || ' ')),
w AS (SELECT DISTINCT pid, unnest(string_split(phrase, ' ')) AS token FROM ph), df AS (SELECT token, count(DISTINCT doc) AS df FROM {TOK} GROUP BY 1), r AS (SELECT pid, min(coalesce(df, 0)) AS df FROM w LEFT JOIN df USING (token) GROUP BY 1)
SELECT e.pid, CASE WHEN r.df <= {RARE} THEN 'text first' ELSE 'place first' END AS plan, count(*) AS docs FROM e JOIN r USING (pid) WHERE CAST(substr(source, 4) AS INTEGER) < 10 GROUP BY ALL"""


@q("txt08_rare_first", RARE_SQL)
def _(spark, d):
    """A phrase with a rare word is looked up as text and then held against the place; one of common words starts from the place's documents."""
    place = t(spark, d, "documents").where(F.substring("source", 4, 9).cast("int") < 10).select(F.col("doc_id").alias("doc"))
    ph = said(spark).union(phrases(spark, d).where("pid >= 0").select((F.col("pid") + 100).cast("int"), "phrase"))
    return postings.rare_first(ndocs(spark, d), ph, place, "doc_id", "norm", RARE).groupBy("pid", "plan").agg(F.count("*").alias("docs"))


@q("txt09_domain_fallback", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'listed' ELSE 'words' END AS tier, lower(array_to_string(regexp_extract_all(url, '//(?:m\\.|www\\.)?([a-z]+)', 1), '')) AS words FROM pages")
def _(spark, d):
    """A listed domain, else the words of its name."""
    p = t(spark, d, "pages").withColumn("key", F.when(F.col("page_id") % 2 == 0, F.col("page_id")))
    listed = t(spark, d, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("key"), F.lit(1).alias("hit"))
    words = F.lower(F.array_join(F.regexp_extract_all("url", F.lit(r"//(?:m\.|www\.)?([a-z]+)"), F.lit(1)), ""))
    return p.join(listed, "key", "left").select("page_id", F.when(F.col("hit").isNotNull(), "listed").otherwise("words").alias("tier"), words.alias("words"))


@q("txt10_place_profile", "WITH p AS (SELECT n_nationkey, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, c_name FROM nation JOIN customer ON n_nationkey = c_nationkey) SELECT n_nationkey, n_name || ': ' || string_agg(c_name, '; ' ORDER BY rn) AS profile FROM p JOIN nation USING (n_nationkey) WHERE rn <= 3 GROUP BY n_nationkey, n_name")
def _(spark, d):
    c = t(spark, d, "customer").withColumn("rn", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("rn <= 3")
    best = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("rn", "c_name"))).alias("top"))
    return t(spark, d, "nation").join(best, "n_nationkey").select("n_nationkey", F.concat("n_name", F.lit(": "), F.array_join(F.transform("top", lambda x: x.c_name), "; ")).alias("profile"))


@q("txt11_parse_near", "SELECT c_custkey, 'Town' || c_custkey AS town, CAST(c_custkey % 90 AS DOUBLE) AS lat, c_mktsegment AS country FROM customer")
def _(spark, d):
    raw = F.concat(F.lit("near Town"), F.col("c_custkey").cast("string"), F.lit(" ("), (F.col("c_custkey") % 90).cast("string"), F.lit(".0, 7.5), "), "c_mktsegment")
    part = lambda k: F.regexp_extract("raw", r"^near (.*?) \((-?[\d.]+), (-?[\d.]+)\), (.*)$", k)
    return t(spark, d, "customer").select("c_custkey", raw.alias("raw")).select("c_custkey", part(1).alias("town"), part(2).cast("double").alias("lat"), part(4).alias("country"))


# -- maths, arrays, maps, JSON, time -------------------------------------------------------------


@q("mth01_scalars", "SELECT event_id, round(ln(1 + value), 6) AS l1, round(log10(1 + value), 6) AS l10, round(sqrt(value * value + 9), 6) AS h, round_even(value * 10, 0) AS even, round(least(5, greatest(1, value)), 6) AS clipped FROM events WHERE value >= 0")
def _(spark, d):
    v = F.col("value")
    return t(spark, d, "events").where("value >= 0").select("event_id", r6(F.log1p(v), "l1"), r6(F.log10(1 + v), "l10"), r6(F.hypot(v, F.lit(3.0)), "h"), F.bround(v * 10, 0).alias("even"), r6(F.least(F.lit(5.0), F.greatest(F.lit(1.0), v)), "clipped"))


@q("arr01_last_by_predicate", "SELECT l_orderkey, arg_max(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) FILTER (l_returnflag = 'R') AS part FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "lineitem").where("l_linenumber <= 7").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("a"))
    return x.select("l_orderkey", F.try_element_at(F.filter("a", lambda s: s.l_returnflag == "R"), F.lit(-1)).l_partkey.alias("part"))


@q("arr02_ordered_distinct", "SELECT doc_id, len(list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> ''))) AS n FROM " + NDOC)
def _(spark, d):
    return ndocs(spark, d).select("doc_id", F.size(F.array_distinct(text.words_of(F.col("norm")))).cast("long").alias("n"))


@q("arr03_split_strip", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def _(spark, d):
    parts = F.filter(F.transform(F.split(F.concat("p_name", F.lit(" , ,"), "p_brand"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return t(spark, d, "part").select("p_partkey", F.array_join(parts, "|").alias("parts"))


@q("arr04_even_subsample", "WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1) SELECT o_custkey, CAST(list_sum(CASE WHEN len(a) <= 4 THEN a ELSE list_transform(range(0, 4), lambda i: a[CAST(floor(i * (len(a) - 1) / CAST(3 AS DOUBLE)) AS BIGINT) + 1]) END) AS BIGINT) AS total FROM o")
def _(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    return o.select("o_custkey", F.aggregate(selection.evenly(F.col("a"), 4), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@q("arr05_padding", "WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_concat(a, [-1, -1, -1, -1, -1])[1:5], ',') AS padded FROM o")
def _(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    padded = F.slice(F.concat("a", F.array_repeat(F.lit(-1).cast("long"), 5)), 1, 5)
    return o.select("o_custkey", F.array_join(padded.cast("array<string>"), ",").alias("padded"))


@q("arr06_dot_product", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS n2 FROM embeddings")
def _(spark, d):
    from stratalens.functions import vectors

    return t(spark, d, "embeddings").select("vec_id", r6(vectors.dot("embedding", "embedding"), "n2", 4))


@q("map01_drop_prefix_json", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size || '","type":"' || p_type || '"}' AS js FROM part""")
def _(spark, d):
    kept = F.map_filter("tags", lambda k, v: ~k.startswith("name"))
    return tags(spark, d).select("p_partkey", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))).alias("js"))


@q("map02_merge", "SELECT p_partkey, p_type AS type, 'x' AS extra, p_partkey % 2 = 0 AS renamed FROM part")
def _(spark, d):
    """The right side wins, without touching the session's map policy: its keys are taken out of the left first."""
    right = F.create_map(F.lit("type"), F.element_at("tags", "type"), F.lit("extra"), F.lit("x"))
    left = F.map_filter("tags", lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return tags(spark, d).select("p_partkey", F.map_concat(left, right).alias("m")).select("p_partkey", F.col("m")["type"].alias("type"), F.col("m")["extra"].alias("extra"), (F.col("p_partkey") % 2 == 0).alias("renamed"))


@q("jsn01_props_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"))


@q("jsn02_json_in_text", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    """The first {...} block of a text, else the field on its own."""
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure! "), "props", F.lit(" Done."))).otherwise(F.regexp_replace("props", r"[{}]", " "))
    block = F.regexp_extract(said, r"(?s)(\{.*?\})", 1)
    whole = F.from_json(block, "k long").k
    return t(spark, d, "events").select("event_id", F.coalesce(whole, F.regexp_extract(said, r'"k":\s*(\d+)', 1).try_cast("long")).alias("k"))


@q("jsn03_typed_projection", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind, nullif(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5, 0) AS k5 FROM events")
def _(spark, d):
    js = F.to_json(F.struct(F.col("event_type").alias("kind"), F.from_json("props", "k long").k.alias("k")))
    x = t(spark, d, "events").select("event_id", F.from_json(js, "kind string, k long").alias("x"))
    return x.select("event_id", F.when(F.col("x.kind").isin("view", "click"), F.col("x.kind")).alias("kind"), F.nullif(F.col("x.k") % 5, F.lit(0).cast("long")).alias("k5"))


@q("jsn04_parse_if_string", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE event_id END AS k FROM events")
def _(spark, d):
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_id").cast("string"))
    return t(spark, d, "events").select("event_id", F.coalesce(F.from_json(F.when(mixed.startswith("{"), mixed), "k long").k, mixed.try_cast("long")).alias("k"))


def merge_documents(docs, labels):
    """All documents and all labels, met by doc_id; what one side lacks is null."""
    a = docs.select("doc_id", "source")
    b = labels.select("doc_id", "quality", F.lit(True).alias("judged"))
    return a.join(b, "doc_id", "full").select("doc_id", "source", "quality", F.coalesce("judged", F.lit(False)).alias("judged"))


@q("jsn05_merge_documents", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.source, b.quality, b.doc_id IS NOT NULL AS judged FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id")
def _(spark, d):
    return merge_documents(t(spark, d, "documents"), t(spark, d, "labels"))


@q("jsn06_trace_document", "SELECT conv_id, count(*) AS steps, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS trace FROM conversations GROUP BY 1")
def _(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("s"))))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"), F.array_join(F.transform(steps, lambda x: x.s), " ").alias("trace"))


@q("tim01_choose_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS taken FROM orders")
def _(spark, d):
    stamp = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy:MM:dd")).otherwise("0000:00:00")
    original = F.when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).otherwise("bad")
    parsed = F.coalesce(F.try_to_date(stamp, "yyyy:MM:dd"), F.to_date(F.try_to_timestamp(original, F.lit("yyyy:MM:dd HH:mm:ss"))))
    return t(spark, d, "orders").select("o_orderkey", parsed.cast("string").alias("taken"))


@q("tim02_iso_and_epoch", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(ts) // 1000 AS ms, CAST(substr(strftime(ts, '%Y-%m-%d'), 1, 4) AS INTEGER) AS year FROM events")
def _(spark, d):
    """Stamps are UTC whatever the session's zone: milliseconds (whole, not rounded) come from the calendar fields."""
    ts = F.col("ts").cast("timestamp_ntz")
    seconds = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    ms = seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000)
    return t(spark, d, "events").select("event_id", F.concat(F.translate(F.substring(ts.cast("string"), 1, 19), " ", "T"), F.lit("Z")).alias("iso"), ms.cast("long").alias("ms"), F.year(ts).alias("year"))


@q("tim03_day_windows", "SELECT strftime(day, '%Y-%m-%d') AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 DAY)) AS day) LEFT JOIN events ON ts >= day AND ts < day + INTERVAL 5 DAY GROUP BY 1")
def _(spark, d):
    """Windows are a sequence; each event finds its window by arithmetic, so the join is on equality."""
    first = F.lit("2024-01-01").cast("date")
    days = spark.range(1).select(F.explode(F.sequence(first, F.lit("2024-01-31").cast("date"), F.expr("interval 5 days"))).alias("day"))
    e = t(spark, d, "events").select("event_id", F.date_add(first, (F.floor(F.datediff(F.to_date("ts"), first) / 5) * 5).cast("int")).alias("day"))
    return days.join(e, "day", "left").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("event_id").alias("n"))


@q("tim04_same_capture", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 600000000 AND abs(a.value - b.value) <= 5")
def _(spark, d):
    """The time range becomes an equi-key: ten-minute buckets, each event in its own and the next."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t(spark, d, "events").select("event_id", "user_id", "value", us.alias("us"), F.floor(us / 600000000).alias("bucket"))
    a = e.select(F.col("event_id").alias("a"), "user_id", F.col("value").alias("va"), F.col("us").alias("ua"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = e.withColumnRenamed("event_id", "b")
    return a.join(b, ["user_id", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("us") - F.col("ua")) <= 600000000) & (F.abs(F.col("va") - F.col("value")) <= 5)).select("a", "b")


# -- hashes --------------------------------------------------------------------------------------


@q("hsh01_bucket_md5_mod", f"SELECT doc_id, CAST({MD5.format(k='doc_id')} AS INTEGER) AS bucket FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", hashing.md5_bucket("doc_id").alias("bucket"))


@q("hsh02_md5_fold", "SELECT doc_id, CAST(('0x' || substr(md5(source), 1, 8))::UBIGINT % 5 AS INTEGER) AS fold FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", hashing.md5_fold("source", 5).alias("fold"))


@q("hsh03_sha_parity", "SELECT doc_id, CAST(('0x' || substr(sha256('tune:' || doc_id), 1, 8))::UBIGINT % 2 AS INTEGER) AS parity FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", hashing.sha_parity("tune", "doc_id").alias("parity"))


@q("hsh04_group_share", "SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha256('split:' || source), 1, 8))::UBIGINT AS DOUBLE) / 4294967296 < 0.4 THEN 'dev' ELSE 'test' END AS split FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.when(hashing.sha_share("split", "source") < 0.4, "dev").otherwise("test").alias("split"))


@q("hsh05_opaque_ids", "SELECT doc_id, substr(sha256('grp:' || doc_id), 1, 16) AS oid FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", hashing.opaque("grp", "doc_id", 16).alias("oid"))


@q("hsh06_hamming", "SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS bits FROM (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) ELSE 0 END))::BIGINT AS h FROM embeddings) a JOIN (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) ELSE 0 END))::BIGINT AS h FROM embeddings) b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 6")
def _(spark, d):
    """Hashes within 6 bits, by covering masks: a pair's differing bits are masked out in some table, where the pair meets."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    h = t(spark, d, "embeddings").select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x).alias("h"))
    return hashing.within_bits(h, "vec_id", "h", 6, 32).select("a", "b", F.col("bits"))


@q("hsh07_fingerprint", "SELECT count(*) AS n, sha256('{\"k\":32,\"metric\":\"cos\",\"rows\":' || count(*) || '}') AS fingerprint FROM embeddings")
def _(spark, d):
    n = t(spark, d, "embeddings").agg(F.count("*").alias("n"))
    return n.select("n", F.sha2(F.to_json(F.struct(F.lit(32).alias("k"), F.lit("cos").alias("metric"), F.col("n").alias("rows"))), 256).alias("fingerprint"))


@q("hsh08_persistent_ids", "SELECT doc_id, substr(sha256('pub:' || doc_id), 1, 20) AS pub FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, substr(sha256('pub2:' || doc_id), 1, 20) FROM documents WHERE doc_id % 2 = 1")
def _(spark, d):
    """Ids assigned earlier stay; only new rows get one (from a digest, so that a recomputed task gives the same)."""
    docs = t(spark, d, "documents").select("doc_id")
    known = docs.where("doc_id % 2 = 0").select("doc_id", hashing.opaque("pub", "doc_id", 20).alias("pub"))
    new = docs.join(known, "doc_id", "left_anti").select("doc_id", hashing.opaque("pub2", "doc_id", 20).alias("pub"))
    return known.unionByName(new)


@q("hsh09_seeded_folds", "SELECT source, CAST((row_number() OVER (ORDER BY sha256('7:' || source)) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM documents)")
def _(spark, d):
    g = t(spark, d, "documents").select("source").distinct()
    dealt = ordering.placed(g.withColumn("at", hashing.order("7", "source")), "at")
    return dealt.select("source", ((F.col("place") - 1) % 5).cast("int").alias("fold"))


@q("jn07_text_join_base", f"SELECT pid, count(*) AS n, min(n_chars) AS shortest FROM ({EXACT}) e JOIN documents d ON e.doc = d.doc_id WHERE d.n_chars > 100 GROUP BY pid")
def _(spark, d):
    base = t(spark, d, "documents").where("n_chars > 100").select(F.col("doc_id").alias("doc"), "n_chars")
    hits = postings.phrase_matches(index(spark, d, said(spark)), said(spark)).select("pid", "doc").distinct()
    return hits.join(base, "doc").groupBy("pid").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"))


@q("jn19_query_block_cross", "SELECT q.vec_id AS qid, count(*) AS n FROM embeddings q, embeddings g WHERE q.vec_id % 100 = 0 AND list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])) > 0 GROUP BY 1")
def _(spark, d):
    """A stated query block against all gallery rows, one broadcast of a checked size."""
    from stratalens.plans.vec_queries import asked, gallery
    from stratalens.operators import vector

    return vector.scored(asked(spark, d), gallery(spark, d)).where("score > 0").groupBy("qid").agg(F.count("*").alias("n"))
