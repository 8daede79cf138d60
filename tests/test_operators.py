import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from stratalens.operators import clustering, evaluate, graph, ordering, postings, selection, spatial, vector
from stratalens.operators.clustering import Group, km
from stratalens.plans import base, io_queries, text_queries
from stratalens.streaming import incremental


def places(n, seed, tight=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lat, lon = (r.gauss(10, 2), r.gauss(179.5, 2)) if tight and i % 2 else (r.uniform(-90, 90), r.uniform(-180, 180))
        out.append((i, max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180))
    return out + [(n, 90.0, 0.0), (n + 1, -90.0, 0.0), (n + 2, 0.0, -180.0), (n + 3, 0.0, 179.999)]


def test_radius_join_equals_brute_force(spark):
    """Dense clusters across the antimeridian and the poles, several radii."""
    a, b = places(150, 1, True), places(200, 2, True)
    left = spark.createDataFrame(a, "id long, lat double, lon double")
    right = spark.createDataFrame(b, "rid long, rlat double, rlon double")
    for radius in (30.0, 400.0, 3000.0, 15000.0):
        got = sorted((r.id, r.rid) for r in spatial.radius_join(left, right, radius).collect())
        want = sorted((i, j) for i, *p in a for j, *q in b if km(p, q) <= radius)
        assert got == want


def test_nearest_far(spark):
    """Points a world away from the only few there are, both sides of the antimeridian and at the poles."""
    a, b = places(80, 5), [(1, 10.0, 179.9), (2, 10.0, -179.9), (3, -89.0, 5.0), (4, 11.0, 179.0)]
    got = spatial.nearest_far(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "rid long, rlat double, rlon double"), "id", "rid").collect()
    assert {r.id: round(r.km, 6) for r in got} == {i: round(min(km(p, x[1:]) for x in b), 6) for i, *p in a}


def test_cells_of_any_size_wrap(spark):
    """A size that does not divide the globe: the last column is narrower and is next to the first."""
    a = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9)], "id long, lat double, lon double")
    g = spark.createDataFrame([(0.0, 179.8), (0.0, -179.8), (0.0, 0.0)], "lat double, lon double")
    got = {r.id: r.density for r in spatial.cell_density(a, g, "id", 7.0, 1).collect()}
    assert got == {1: 2, 2: 2}


def test_running_sums(spark):
    r = random.Random(9)
    rows = [(i, r.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "s long, v long").repartition(5)
    got = {x.s: x.b for x in ordering.summed(df, "s", "v", "b").collect()}
    total, want = 0, {}
    for i, v in rows:
        want[i], total = total, total + v
    assert got == want


def test_bootstrap_interval(spark):
    """Near the textbook interval of a mean, and the plain mean itself."""
    r = random.Random(10)
    ys = [r.choice([-1, 0, 0, 1, 1]) for _ in range(800)]
    got = evaluate.bootstrap(spark.createDataFrame(list(enumerate(ys)), "id long, y int"), "y", "id", 1000).first()
    mean, se = np.mean(ys), np.std(ys) / math.sqrt(len(ys))
    assert math.isclose(got["mean"], mean) and abs(got.low - (mean - 1.96 * se)) < 0.4 * se and abs(got.high - (mean + 1.96 * se)) < 0.4 * se


def test_many_phrases_in_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b a"), (3, ""), (4, None), (5, "ab c")], "id long, norm string")
    said = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a b c a b"), (4, "b"), (5, "zz"), (6, "a b"), (7, "")], "pid int, phrase string")
    want = {1: 1, 2: 2, 3: 1, 4: 2, 6: 1}
    for most in (32 << 20, 40):
        monkeypatch.setattr(postings, "PATTERN_BYTES", most)
        assert {r.pid: r.n for r in postings.count_phrases(docs, said, "norm").collect()} == want


def test_hashes_within_bits(spark):
    from stratalens.functions import hashing

    for radius, bits in ((6, 32), (2, 16)):
        masks = hashing.covering_masks(radius, bits)
        r = random.Random(radius)
        assert all(any(not m & d for m in masks) for d in (sum(1 << b for b in r.sample(range(bits), radius)) for _ in range(2000)))
    r = random.Random(3)
    centre = r.getrandbits(32)
    rows = [(i, centre ^ sum(1 << b for b in r.sample(range(32), r.randint(0, 5)))) for i in range(120)] + [(200 + i, r.getrandbits(32)) for i in range(100)]
    got = sorted(map(tuple, hashing.within_bits(spark.createDataFrame(rows, "id long, h long"), "id", "h", 6, 32).collect()))
    want = sorted((i, j, (x ^ y).bit_count()) for i, x in rows for j, y in rows if i < j and (x ^ y).bit_count() <= 6)
    assert got == want


def test_geocode(spark):
    g = spark.createDataFrame([(1, "Ham", "A", 10.0, 10.0), (2, "ham", "A", 10.1, 10.0), (3, "Ham", "B", 50.0, 0.0), (4, "Beeland", "B", 51.0, 0.0), (5, "Ham", "A", 20.0, 10.0)], "id long, name string, cc string, lat double, lon double")
    countries = spark.createDataFrame([("ayland", "A"), ("beeland", "B")], "last string, cc string")
    asked = spark.createDataFrame([(1, "Ham, Ayland"), (2, "Ham, Beeland"), (3, "Ham"), (4, "Nowhere, Beeland"), (5, "Nowhere"), (6, ""), (7, None), (8, " Ham , x, Nocountry ")], "q int, place string")
    got = {r.q: r.id for r in spatial.geocode(asked, g, countries, "q").collect()}
    assert got == {1: 1, 2: 3, 3: 1, 4: 4, 5: None, 8: 1}


def test_nearest_ring(spark):
    a, b = places(60, 3), places(40, 4)
    got = spatial.nearest_ring(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "rid long, rlat double, rlon double"), "id", "rid").collect()
    assert len(got) == len(a)
    for r in got:
        p = next(x[1:] for x in a if x[0] == r.id)
        assert math.isclose(r.km, min(km(p, x[1:]) for x in b), abs_tol=1e-9)


def ranked(*rows):
    return Group.of([dict(zip(("rank", "lat", "lon", "score"), r, strict=True)) for r in rows])


def test_first_fit_clusters():
    out = clustering.first_fit(ranked((1, 10.0, 10.0, 0.9), (2, 10.001, 10.0, 0.8), (3, 11.0, 10.0, 0.7)), 0.5, 10)
    assert [(x[0], x[4]) for x in out] == [(1, 2), (2, 1)]


def test_first_fit_boundary_is_inclusive():
    a, b = (0.0, 0.0), (0.0, 1.0)
    assert len(clustering.first_fit(ranked((1, *a, 1.0), (2, *b, 0.5)), km(a, b), 5)) == 1
    assert len(clustering.agreement_areas(Group.of([dict(pos=1, lat=0.0, lon=0.0, score=1.0), dict(pos=2, lat=0.0, lon=1.0, score=0.5)]), km(a, b))) == 2


def test_round_robin_fusion():
    def lists(*p):
        return Group.of([dict(place=i + 1, lat=x, lon=0.0) for i, x in enumerate(p)])

    out = clustering.round_robin(lists(0.0, 20.0), lists(0.0, 10.0), 25.0, 10)
    assert [(s, p) for _, s, p, *_ in out] == [("a", 1), ("b", 2), ("a", 2)]
    assert [(s, p) for _, s, p, *_ in clustering.round_robin(lists(0.0, 20.0), Group.of([]), 25.0, 10)] == [("a", 1), ("a", 2)]


def test_agreement_beats_a_lone_score():
    rows = [dict(pos=0, lat=50.0, lon=0.0, score=0.9), *[dict(pos=i, lat=10.0 + i / 100, lon=0.0, score=0.8 + i / 100) for i in (1, 2, 3)]]
    out = clustering.agreement_areas(Group.of(rows))
    assert out[0][3] == 3 and out[0][2] == 3 and math.isclose(sum(x[4] for x in out), 1.0)


def test_one_user_weighs_one():
    rows = [dict(is_place=False, user="u", id=i, lat=0.0, lon=0.0) for i in range(29)] + [dict(is_place=True, user="p", id=100, lat=30.0, lon=0.0), dict(is_place=False, user="v", id=101, lat=30.0, lon=0.0)]
    out = clustering.text_clusters(Group.of(rows))
    assert (out[0][1], round(out[0][3], 6)) == (30.0, 2.0) and math.isclose(out[1][3], 1.0)


def test_order_of_arrival_does_not_matter(spark):
    r = random.Random(1)
    rows = [(q, i, r.uniform(0, 2), r.uniform(0, 2), r.random()) for q in range(20) for i in range(15)]
    results = []
    for parts in (1, 8):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "qid long, pos long, lat double, lon double, score double").repartition(parts)
        got = clustering.apply(df, "qid", "long", clustering.agreement_areas, "area int, founder long, best long, members long, support double")
        results.append(sorted(map(tuple, got.collect())))
    assert results[0] == results[1]


def test_author_guard(spark):
    r = np.random.default_rng(0)
    g = [(i, i % 3 if i % 7 else None, r.normal(size=8).tolist()) for i in range(60)]
    gallery = spark.createDataFrame(g, "gid long, gauthor long, gvec array<double>")
    queries = spark.createDataFrame([(0, 1, g[1][2]), (1, None, g[2][2])], "qid long, qauthor long, qvec array<double>")
    got = vector.top_k(vector.scored(queries, gallery, vector.not_same_author()), 10).collect()
    assert all(x.gauthor != 1 for x in got if x.qid == 0) and len(got) == 20
    for q, author, v in ((0, 1, g[1][2]), (1, None, g[2][2])):
        want = sorted(((-float(np.dot(v, e)), i) for i, a, e in g if author is None or a is None or a != author))[:10]
        assert [x.gid for x in sorted(got, key=lambda x: x.rank) if x.qid == q] == [i for _, i in want]


def brute_nearest(q, g, k, guard, own):
    out = []
    for i, a, v in q:
        best = sorted((-round(float(np.dot(v, e)), 12), j) for j, b, e in g if not (guard and a is not None and b is not None and a == b) and not (own and i == j))[:k]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(best)]
    return sorted(out)


def test_nearest_equals_brute_force(spark, monkeypatch):
    """One block, many blocks on both sides, copies of one vector (ties by id), unknown authors, fewer rows than k, nothing at all."""
    r = np.random.default_rng(4)
    g = [(i, i % 5 if i % 7 else None, (r.normal(size=16) if i % 3 else np.ones(16)).astype(np.float32).astype(float).tolist()) for i in range(300)]
    gallery = spark.createDataFrame(g, "gid long, gauthor long, gvec array<double>")
    queries = spark.createDataFrame(g, "qid long, qauthor long, qvec array<double>")
    for most in (64 << 20, 5000):
        monkeypatch.setattr(vector, "QUERY_BYTES", most)
        for guard, own in ((True, True), (False, False)):
            got = sorted((x.qid, x.gid, x["rank"]) for x in vector.nearest(queries, gallery, 6, guard, own).collect())
            assert got == brute_nearest(g, g, 6, guard, own)
        few = vector.nearest(queries, gallery.where("gid < 3"), 6, own=True).collect()
        assert len(few) == 297 * 3 + 3 * 2
        pairs = vector.scored(queries.where("qid < 9"), gallery, F.col("gid") != F.col("qid")).collect()
        assert len(pairs) == 9 * 299 and all(abs(x.score - float(np.dot(g[x.qid][2], g[x.gid][2]))) < 1e-9 for x in pairs)
    assert vector.nearest(queries.limit(0), gallery, 6).count() == vector.nearest(queries, gallery.limit(0), 6).count() == 0


def test_no_pair_join_in_the_knn_plan(spark):
    df = base.QUERIES["vec12_knn_graph"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b a"), (3, ""), (4, None)], "id long, norm string")
    index = postings.postings(docs, "id", "norm")
    said = spark.createDataFrame([(1, "a b"), (2, "b c a"), (3, "a a"), (4, "c x y")], "pid int, phrase string")
    assert sorted((r.pid, r.doc, r.start) for r in postings.phrase_matches(index, said).collect()) == [(1, 1, 0), (1, 1, 3), (2, 1, 1)]
    assert sorted((r.pid, r.doc, r.tier) for r in postings.relaxed(index, said).collect()) == [(1, 1, 1), (2, 1, 1), (4, 1, 3)]


def test_pagerank_mass(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (2, 1, 0.5), (3, 1, 1.0)], "src long, dst long, w double")
    seeds = spark.createDataFrame([(9, 1, 1.0, 9)], "q long, node long, p double, own long")
    got = {r.node: r.p for r in graph.diffuse(seeds, edges, 3, 0.5, 10).collect()}
    p = {1: 1.0}
    for _ in range(3):
        n = {}
        for s, d, w in ((1, 2, 1.0), (2, 3, 0.5), (2, 1, 0.5), (3, 1, 1.0)):
            n[d] = n.get(d, 0) + p.get(s, 0) * w * 0.5
        n[1] = n.get(1, 0) + 0.5
        total = sum(n.values())
        p = {k: v / total for k, v in n.items()}
    assert all(math.isclose(got.get(k, 0), v, abs_tol=1e-12) for k, v in p.items())


def test_polygon_with_a_hole(spark):
    ring = lambda h: [(-h, -h), (-h, h), (h, h), (h, -h), (-h, -h)]
    poly = spark.createDataFrame([(1, [ring(10.0), ring(2.0)], -10.0, 10.0, -10.0, 10.0)], "pid int, rings array<array<struct<lat:double,lon:double>>>, lat_min double, lat_max double, lon_min double, lon_max double")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 11.0, 0.0)], "id int, lat double, lon double")
    assert [r.id for r in spatial.in_polygon(pts, poly).collect()] == [1]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (0, 0)], "s int, y int")
    assert evaluate.auc(df, "s", "y").first().auc == 3.5 / 4


def in_hash_order(rows, salt):
    return sorted(rows, key=lambda r: hashlib.sha256(f"{salt}:{r['id']}".encode()).hexdigest())


def test_balanced_pick_equals_a_plain_walk(spark):
    """Over batches so small that scopes must be filled again, with rows whose values are unknown."""
    r = random.Random(2)
    rows = [dict(id=i, lat=r.uniform(-60, 60), lon=r.uniform(-180, 180), uploader=i % 11 if i % 13 else None, country=i % 7, continent=f"k{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, uploader int, country int, continent string")
    caps = {"uploader": 5, "country": 8, "continent": 12}
    picked, used, open_names = [], {}, sorted({x["continent"] for x in rows})

    def fits(x):
        return all(x[c] is None or used.get((c, x[c]), 0) < n for c, n in caps.items()) and all(km((x["lat"], x["lon"]), (y["lat"], y["lon"])) >= 300 for y in picked) and x not in picked

    while open_names and len(picked) < 40:
        for name in list(open_names):
            got = next((x for x in in_hash_order(rows, "pick") if x["continent"] == name and fits(x)), None)
            if got is None:
                open_names.remove(name)
            elif len(picked) < 40:
                picked.append(got)
                for c in caps:
                    used[c, got[c]] = used.get((c, got[c]), 0) + 1
    for batch in (3, 2000):
        out = selection.balanced_pick(df, 40, 5, 8, 12, 300.0, batch=batch).orderBy("position").collect()
        assert [x.id for x in out] == [x["id"] for x in picked]


def test_stream_restart(spark, tmp_path):
    """A second run from the checkpoint takes only new files, and no id twice."""
    source, out, point = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for batch in ([(1, "a"), (2, "b"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(batch, "id long, v string").write.mode("append").parquet(source)
        incremental.append_to(incremental.new_rows(spark, source, "id long, v string", "id"), out, point).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_evenly(spark):
    df = spark.createDataFrame([(list(range(100)),), ([1, 2],)], "a array<int>")
    got = [r.x for r in df.select(selection.evenly(F.col("a"), 5).alias("x")).collect()]
    assert got[0][0] == 0 and got[0][-1] == 99 and len(got[0]) == 5 and got[1] == [1, 2]


def test_search_dump_and_merge_take_odd_ids(spark):
    """Odd ids, null fields, documents without a label and labels without a document."""
    docs = spark.createDataFrame([(1, "en", "a"), (2, None, "b"), (3, "de", None), (4, "fr", "c")], "doc_id long, lang string, source string")
    labels = spark.createDataFrame([(1, 1), (4, None), (7, 0)], "doc_id long, quality int")
    assert sorted(tuple(r) for r in io_queries.search_dump(docs).collect()) == [(1, "en"), (2, None), (3, "de"), (4, "fr")]
    got = sorted((tuple(r) for r in text_queries.merge_documents(docs, labels).collect()), key=repr)
    assert got == [(1, "a", 1, True), (2, "b", None, False), (3, None, None, False), (4, "c", None, True), (7, None, 0, True)]
    for name in ("src14_search_dump", "jsn05_merge_documents"):
        assert base.QUERIES[name](spark, "/root/testdata/sf0.001").where("doc_id % 2 = 1").count() > 0


def test_places_of_all_rows(spark):
    """Ties in the first key, nulls last, several ranges, and a table without rows."""
    r = random.Random(3)
    rows = [(i, r.choice([None, 1, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(ordering.placed(df, F.desc_nulls_last("v"), "id").collect(), key=lambda x: x.place)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(x) for x in got] == [(*x, k) for k, x in enumerate(want, 1)]
    assert ordering.placed(df.limit(0), "id").collect() == []


def test_whole_sorts_keep_every_row(spark):
    for name, table in (("srt01_multi_key_sort", "part"), ("srt02_stable_sort", "documents"), ("srt04_retrieval_order", "labels")):
        n = base.t(spark, "/root/testdata/sf0.01", table).count()
        assert n > 200 and sorted(x.place for x in base.QUERIES[name](spark, "/root/testdata/sf0.01").collect()) == list(range(1, n + 1))


def test_str10_splits_whole_texts(spark, tmp_path):
    """All characters but the line breaks between passages are in a passage, in texts far beyond 6000 characters."""
    texts = [(1, "\n".join(f"Line {i} of a long text." for i in range(2000))), (2, "One sentence more. " * 3000), (3, "short"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = base.QUERIES["str10_passages"](spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("chars"), F.count("*")).collect()
    assert {r[0]: r[1] + r[2] - 1 for r in got} == {i: len(x.strip()) for i, x in texts if x}


def test_hash_cohort_loses_no_rare_region(spark):
    """A region whose rows lie behind many others of their sequences, and countries that fill up."""
    r = random.Random(5)
    rows = [(i, f"c{r.randrange(6)}", f"s{r.randrange(4)}", "common") for i in range(1500)]
    last = sorted(range(2000, 6000), key=lambda i: hashlib.sha256(f"cohort:{i}".encode()).hexdigest())[-3:]
    rows += [(i, "far", f"s{k}", "rare") for k, i in enumerate(last)]
    rows += [(i, f"c{r.randrange(6)}", f"t{r.randrange(40)}", "common") for i in range(7000, 7400)]
    df = spark.createDataFrame(rows, "id long, country string, sequence string, region string")
    every = in_hash_order([dict(zip(df.columns, x, strict=True)) for x in rows], "cohort")
    for size, cap in ((4, 2), (10, 3), (60, 5)):
        want, seen, used = [], set(), {}

        def take(among):
            for x in among:
                if x["id"] not in want and x["sequence"] not in seen and used.get(x["country"], 0) < cap:
                    want.append(x["id"]), seen.add(x["sequence"])
                    used[x["country"]] = used.get(x["country"], 0) + 1
                    return True
            return False

        for _ in range(2):
            for region in ("common", "rare"):
                take([x for x in every if x["region"] == region])
        while len(want) < size and take(every):
            pass
        for batch in (5, 2000):
            assert [x.id for x in selection.hash_cohort(df, size, cap, batch=batch).orderBy("position").collect()] == want[:size]
        assert any(i in last for i in want)
        capped = selection.cap_per_key(df, "sequence", 25, "cohort", "id").drop("rn")
        assert not any(x.id in last for x in capped.collect())


def test_new_areas_keep_off_what_is_taken():
    rows = [dict(pos=1, lat=0.0, lon=0.0, w=0.1, taken=True), dict(pos=2, lat=0.1, lon=0.0, w=0.9, taken=False), dict(pos=3, lat=10.0, lon=0.0, w=0.5, taken=False), dict(pos=4, lat=10.1, lon=0.0, w=0.4, taken=False), dict(pos=5, lat=20.0, lon=0.0, w=0.3, taken=False), dict(pos=6, lat=30.0, lon=0.0, w=0.2, taken=False)]
    assert [(a, f, round(m, 6)) for a, f, m in clustering.new_areas(Group.of(rows))] == [(1, 3, 0.9), (2, 5, 0.3)]


def test_epoch_ms_keeps_off_the_session_zone(spark, tmp_path):
    """Stamps just before a whole millisecond, before 1970, and in the hour that a zone skips."""
    import datetime as dt

    stamps = [dt.datetime(2024, 1, 1, 0, 9, 58, 778999), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 3, 10, 2, 30, 0, 1), dt.datetime(2024, 11, 3, 1, 30)]
    spark.createDataFrame(list(enumerate(stamps)), "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    want = {i: (x.strftime("%Y-%m-%dT%H:%M:%SZ"), (x - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1), x.year) for i, x in enumerate(stamps)}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = base.QUERIES["tim02_iso_and_epoch"](spark, str(tmp_path)).collect()
            assert {r.event_id: (r.iso, r.ms, r.year) for r in got} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rare_and_common_phrases_agree(spark):
    """Both ways of looking a phrase up give the documents of the place that have it."""
    docs = spark.createDataFrame([(i, f"common word {'rare bird' if i % 9 == 0 else 'other thing'} end") for i in range(50)], "id long, norm string")
    said = spark.createDataFrame([(1, "rare bird"), (2, "common word"), (3, "no such"), (4, "bird rare")], "pid int, phrase string")
    place = docs.where("id < 30").select(F.col("id").alias("doc"))
    got = sorted((r.pid, r.doc, r.plan) for r in postings.rare_first(docs, said, place, "id", "norm", 10).collect())
    assert got == sorted([(1, i, "text first") for i in range(0, 30, 9)] + [(2, i, "place first") for i in range(30)])
