import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import geo, hashing, text, vectors
from stratalens.sources import archives, readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_domains(spark):
    say = lambda s, **k: one(spark, text.domain(F.lit(s), **k))
    assert say("https://www.porsche.lu/fr/") == "porsche.lu"
    assert say("shop.example.co.uk") == "example.co.uk"
    assert say("St.Mary", tlds=["com", "lu"]) is None
    assert say("no domain") is None


def test_phones(spark):
    say = lambda s: one(spark, text.phone(F.lit(s)))
    assert say("+352 26 12 34") == "+352261234"
    assert say("00352-261234") == "+352261234"
    assert say("1998") is None and say("call 12345678 now") is None


def test_norm():
    assert text.normalise("Café—Straße_Ⅻ") == "cafe strasse xii"
    assert text.normalise(None) is None


def test_norm_latin_equals_norm(spark):
    words = ["Straße ÀÉÎ", "ñandú, über!", "a_b  c", "", "çà"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select(text.norm_latin(F.col("w")).alias("a"), text.norm(F.col("w")).alias("b")).collect():
        assert r.a == r.b


def brute_passages(text, size=700):
    import re

    units = re.split(r"\n+", text or "")
    if len(units) == 1 and len(units[0]) > size:
        units = re.split(r"(?<=[.!?。])\s+", units[0])
    out = []
    for unit in filter(None, (u.strip() for u in units)):
        if out and len(out[-1]) + len(unit) <= size:
            out[-1] += "\n" + unit
        else:
            out.append(unit)
    return out


def test_passages(spark):
    texts = [". ".join("word " * 30 + str(i) for i in range(20)), "a\n\nb", None, "", " \n \n", "x" * 2000, "One. Two! " * 200, "line\n" * 500, "\n".join(["y" * 700, "z", "w" * 699])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r.p for r in df.select("i", text.passages(F.col("x")).alias("p")).collect()}
    assert got == {i: brute_passages(x) for i, x in enumerate(texts)}
    assert one(spark, F.size(text.passages(F.lit("ab\ncd " * 400), most=100))) == 1


def test_folding_by_code_point_equals_folding_the_text():
    """The definition on whole texts: compatibility composed, case folded, decomposed, marks dropped."""
    import re
    import sys
    import unicodedata

    def whole(x):
        x = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", x).casefold())
        return re.sub(r"[\W_]+", " ", "".join(c for c in x if not unicodedata.combining(c))).strip()

    for start in range(0, sys.maxunicode, 997):
        for p in range(start, min(start + 60, sys.maxunicode)):
            if not 0xD800 <= p <= 0xDFFF:
                assert text.normalise(f"a{chr(p)}b") == whole(f"a{chr(p)}b"), hex(p)
    for x in ("e\u0301le\u0300ve", "ΑΣ", "İstanbul", "ᾳ α\u0345", "가 \u1100\u1161", "ﬁn Ⅻ _x_", "straße—GROẞ"):
        assert text.normalise(x) == whole(x)


def test_geodesic_known():
    import pandas as pd

    km = geo.geodesic_km(pd.Series([48.8566, 0.0, 10.0]), pd.Series([2.3522, 0.0, 10.0]), pd.Series([52.52, 0.0, 10.0]), pd.Series([13.405, 1.0, 10.0]))
    assert abs(km[0] - 879.7) < 1.5 and abs(km[1] - 111.3195) < 1e-3 and km[2] == 0


def test_score_and_reward(spark):
    assert one(spark, geo.score_5000(F.lit(0.0))) == 5000
    d = [0.4, 12.0, 10_000.0]
    got = [one(spark, geo.reward_band(F.lit(x))) for x in d]
    assert got[0] > 1.99 and 1.49 < got[1] < 1.5 and got[2] < 0.01
    assert one(spark, geo.reward_band(F.lit(None).cast("double"))) == 0


def test_md5_bucket_is_the_whole_number(spark):
    import hashlib

    keys = [str(random.Random(i).getrandbits(60)) for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.md5_bucket("k").alias("b"))
    for r in df.collect():
        assert r.b == int(hashlib.md5(r.k.encode()).hexdigest(), 16) % 100


def test_perceptual_hash():
    r = np.random.default_rng(1)
    a = r.random((32, 32))
    near = hashing.perceptual(a + r.normal(0, 0.001, (32, 32)))
    assert (hashing.perceptual(a) ^ near).bit_count() <= 6
    assert (hashing.perceptual(a) ^ hashing.perceptual(r.random((32, 32)))).bit_count() > 6


def test_unit_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(float("nan")), F.lit(float("inf")), F.lit(4.0))
    assert one(spark, vectors.unit(v)) == [0.6, 0.0, 0.0, 0.8]


def test_sql_rows():
    line = r"INSERT INTO `t` VALUES (1,'it''s',NULL),(2,'a\'b, (c)',3.5),(3,'x\\n',-1);"
    assert readers.sql_rows(line) == [["1", "it's", None], ["2", "a'b, (c)", "3.5"], ["3", "x\\n", "-1"]]
    assert readers.sql_rows("CREATE TABLE x (a int)") == [] and readers.sql_rows(None) == []


def test_private_columns_are_refused(spark):
    with pytest.raises(ValueError):
        writers.assert_public(spark.createDataFrame([(1, 2.0)], "id int, truth double"))


def test_manifest(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row long, embedding array<double>")
    assert readers.check_manifest(df, 2, 2) is df
    with pytest.raises(ValueError):
        readers.check_manifest(df, 3, 2)


def test_tar_and_xml_and_matrix(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        info = tarfile.TarInfo("x.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    got = archives.tar_members(spark.read.format("binaryFile").load(str(tmp_path / "a.tar"))).collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("x.txt", b"abc")]
    np.arange(12, dtype="<f4").tofile(tmp_path / "m.bin")
    rows = readers.matrix_rows(str(tmp_path / "m.bin"), spark, 4).collect()
    assert [(r.row, r.embedding[0]) for r in sorted(rows)] == [(0, 0.0), (1, 4.0), (2, 8.0)]


def test_na_stays_a_string(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,lat,lon,cc\n1,10,20,NA\n2,x,3,DE\n3,95,3,DE\n")
    got = readers.points_csv(spark, str(tmp_path / "p.csv"), "id int, lat double, lon double, cc string", "lat", "lon").collect()
    assert [(r.id, r.cc) for r in got] == [(1, "NA")]


def test_gazetteer(spark, tmp_path):
    line = "\t".join(["7", "Köln", "Koln", "Cologne,Colonia", "50.9", "6.9", "P", "PPL", "DE", "", "", "", "", "", "1000000", "", "", "", ""])
    (tmp_path / "g.txt").write_text(line + "\n")
    got = readers.gazetteer(spark, str(tmp_path / "g.txt")).collect()
    assert {(r.id, r.alias, r.cc) for r in got} == {(7, a, "DE") for a in ("Köln", "Cologne", "Colonia")}


def test_haversine_clamps(spark):
    assert math.isclose(one(spark, geo.haversine(0.0, 0.0, 0.0, 180.0)), math.pi * 6371.0)


def test_map_objects_round_trip(spark):
    """Nodes, ways and relations come back with their tags; a key and kinds are filtered; empty files give nothing."""
    from stratalens.sources import mapobjects as m

    r = random.Random(1)
    nodes = [(r.randint(-(1 << 40), 1 << 50), round(r.uniform(-90, 90), 7), round(r.uniform(-180, 180), 7), {"name": f"é{i}"} if i % 3 else {}) for i in range(500)]
    ways = [(i + 1, [n[0] for n in r.sample(nodes, 7)], {"highway": "x"} if i % 2 else {}) for i in range(40)]
    relations = [(9, [("way", 1, "outer"), ("node", nodes[0][0], ""), ("way", 2, "inner")], {"type": "multipolygon"}), (10, [], {})]
    content = m.encode(nodes, ways, relations)
    files = spark.createDataFrame([("a", content), ("b", b""), ("c", m.encode([]))], "path string, content binary")
    got = m.map_objects(files).collect()
    assert [(x.id, round(x.lat, 7), round(x.lon, 7), x.tags) for x in got if x.kind == "node"] == nodes
    assert [(x.id, x.refs, x.tags) for x in got if x.kind == "way"] == ways
    assert [(x.id, [tuple(y) for y in x.members], x.tags) for x in got if x.kind == "relation"] == relations
    assert {x.id for x in m.map_objects(files, ("way",), "highway").collect()} == {i for i, _, t in ways if t}
    assert m.numbers(b"".join(map(m._bytes, [0, 1, 127, 128, 300, (1 << 64) - 1]))).tolist() == [0, 1, 127, 128, 300, (1 << 64) - 1]


def test_sharded_members(spark):
    """Entries within a shard, over several, at the edges, empty ones, and shards of unlike sizes."""
    whole = bytes(range(256)) * 5
    cuts = [0, 100, 101, 400, 400, 1000, len(whole)]
    shards = spark.createDataFrame([(i, whole[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "shard int, content binary")
    r = random.Random(2)
    index = [(0, 0, 100), (1, 99, 3), (2, 0, len(whole)), (3, 400, 0), (4, len(whole) - 1, 1)] + [(5 + i, (a := r.randrange(len(whole))), r.randint(0, len(whole) - a)) for i in range(60)]
    got = {x.id: bytes(x.content) for x in archives.sharded_members(shards, spark.createDataFrame(index, "id int, offset long, size long")).collect()}
    assert got == {i: whole[a : a + n] for i, a, n in index}


def test_zip_members_by_range(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/x.txt", "hello " * 1000)
        z.writestr("b/é.txt", "stored", zipfile.ZIP_STORED)
        z.writestr("empty", "")
        z.comment = b"a comment"
    data, asked = out.getvalue(), []

    def fetch(a, b):
        asked.append((a, b))
        return data[a:b]

    entries = archives.zip_directory(fetch, len(data))
    assert [e.name for e in entries] == ["a/x.txt", "b/é.txt", "empty"] and len(asked) == 2
    assert [archives.zip_member(fetch, e) for e in entries] == [b"hello " * 1000, b"stored", b""]
    files = spark.createDataFrame([("z", data)], "path string, content binary")
    assert [(r.name, bytes(r.content)) for r in archives.zip_members(files, r"b/.*").collect()] == [("b/é.txt", b"stored")]
    with pytest.raises(ValueError):
        archives.zip_directory(lambda a, b: b"no zip", 6)
    with pytest.raises(ValueError):
        archives.zip_member(lambda a, b: data[a:b].replace(b"stored", b"st0red"), entries[1])


def test_cached_search_asks_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def index(missing):
        calls.append(sorted(r.key for r in missing.collect()))
        return missing.where("key <> 'none'").select("key", F.concat(F.lit("["), "key", F.lit("]")).alias("answer"))

    asked = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    assert {(r.key, r.answer, r.src) for r in readers.cached_search(asked("1", "none"), path, index).collect()} == {("1", "[1]", "index"), ("none", "[]", "index")}
    assert {(r.key, r.answer, r.src) for r in readers.cached_search(asked("1", "2", "none"), path, index).collect()} == {("1", "[1]", "cache"), ("2", "[2]", "index"), ("none", "[]", "cache")}
    assert calls == [["1", "none"], ["2"]]


def test_key_ranges_cover_all(spark, tmp_path):
    rows = [(i * 3,) for i in range(100)] + [(None,)]
    spark.createDataFrame(rows, "k long").write.parquet(str(tmp_path / "t"))
    for parts in (1, 4, 40):
        got = readers.by_key_ranges(spark, str(tmp_path / "t"), "k", 0, 297, parts)
        assert got.count() == 101 and got.where("k is not null").select("k").distinct().count() == 100
    plan = readers.by_key_ranges(spark, str(tmp_path / "t"), "k", 0, 297, 4)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,75)" in plan.replace(" ", "")


def test_database_table_by_ranges(spark):
    """The same over a database connection, on the embedded engine that comes with Spark."""
    url = "jdbc:derby:memory:ranges;create=true"
    spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k int, v string").write.format("jdbc").options(url=url, dbtable="t").mode("overwrite").save()
    got = readers.table_by_ranges(spark, url, "t", "k", 0, 50, 4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 50


def test_replaced_whole_and_staged(spark, tmp_path):
    df = spark.range(10)
    writers.replace_whole(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        writers.replace_whole(df.select(F.raise_error(F.lit("lost")).alias("id")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
    sizes = writers.staged_copy(spark, str(tmp_path / "t"), str(tmp_path / "s"))
    assert sizes and spark.read.parquet(str(tmp_path / "s")).count() == 10
    with pytest.raises(FileExistsError):
        writers.staged_copy(spark, str(tmp_path / "t"), str(tmp_path / "s"))


def test_worker_queue_and_pacing(spark):
    from stratalens.streaming import incremental

    got = incremental.worked(spark.range(100), 3, "id", lambda me, batches: (x for pdf in batches for x in pdf["id"].tolist()))
    assert sorted(r.result for r in got.collect()) == list(range(100))
    with pytest.raises(Exception):
        incremental.worked(spark.range(10), 2, "id", lambda me, batches: (1 // 0 for _ in batches))
    made = [0.0, 0.1, 5.0, 5.0, 5.2]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(made)], "g int, i int, made double")
    starts = [r.start for r in incremental.paced(df, "g", "made", 1.0, "i").orderBy("i").collect()]
    want, free = [], -1e9
    for x in made:
        free = max(x, free + 1.0)
        want.append(free)
    assert np.allclose(starts, want)
    assert [one(spark, incremental.backoff(F.lit(float(k)))) for k in (0, 3, 40)] == [2.0, 8.0, 30.0]
    assert one(spark, incremental.backoff(F.lit(1.0), F.lit(7.5))) == 7.5
