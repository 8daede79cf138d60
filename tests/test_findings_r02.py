"""Small cases of the second round's findings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalens.operators import clustering, evaluate, graph, postings, spatial, vector
from stratalens.operators.clustering import Group
from stratalens.sources import archives
from stratalens.plans import cluster_queries, geo_queries, io_queries, registry, rel_queries

SF = "/root/testdata/sf0.01"


def test_evl14_near_values_go_by_place(spark):
    """A millionth is a place, as in the SQL: 0.5000004 at place 2 does not beat 0.5 at place 1, but 0.500002 does."""
    rows = [(1, 1, 0.5), (1, 2, 0.5000004), (2, 1, 0.5), (2, 2, 0.500002), (3, 1, 0.5), (3, 2, 0.5)]
    df = spark.createDataFrame(rows, "qid long, pos long, v double")
    got = df.groupBy("qid").agg(cluster_queries.best_less_place(F.col("v")))
    assert {r.qid: r.pick for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_clu07_uses_the_sql_key(spark, monkeypatch):
    near = spark.createDataFrame([(1, 1, 1.0, 0.2), (1, 2, 1.0000004, 0.2)], "qid long, pos long, support double, w double")
    monkeypatch.setattr(cluster_queries, "supported", lambda s, d: near)
    assert {r.pick for r in registry.QUERIES["clu07_rescoring_grid"](spark, "").collect()} == {1}


def test_clu06_uses_the_sql_key(spark, monkeypatch):
    near = spark.createDataFrame([(1, 1, 0.5, 0.2), (1, 2, 0.5000004, 0.2)], "qid long, pos long, support double, w double")
    monkeypatch.setattr(cluster_queries, "supported", lambda s, d: near)
    assert [r.pick for r in registry.QUERIES["clu06_agreement_pick"](spark, "").collect()] == [1]


def test_clu15_uses_the_sql_key(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 1, 5.000004, 1.0), (1, 2, 5.0, 1.0)], "qid long, pos long, km double, w2 double")
    monkeypatch.setattr(cluster_queries, "soft", lambda s, d: None)
    monkeypatch.setattr(cluster_queries, "pool_pairs", lambda p: pairs)
    assert [r[1] for r in registry.QUERIES["clu15_kernel_pick"](spark, "").collect()] == [1]


def test_clu14_uses_the_sql_key(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 1, 5.000001, 1.0), (1, 2, 5.0, 1.0)], "qid long, pos long, km double, w2 double")
    monkeypatch.setattr(cluster_queries, "soft", lambda s, d: None)
    monkeypatch.setattr(cluster_queries, "pool_pairs", lambda p: pairs)
    assert [r[1] for r in registry.QUERIES["clu14_weighted_medoid"](spark, "").collect()] == [1]


def ring(half):
    return [(-half, -half), (-half, half), (half, half), (half, -half), (-half, -half)]


def test_points_on_an_edge_are_inside(spark):
    """Of the outer ring and of a hole, at every side and corner; within the hole is outside."""
    pts = spark.createDataFrame([(1, 4.0, 0.0), (2, -4.0, 1.0), (3, 0.0, 4.0), (4, 0.0, -4.0), (5, 4.0, 4.0), (6, 1.0, 0.0), (7, 0.0, -1.0), (8, 0.5, 0.5), (9, 4.01, 0.0)], "id long, lat double, lon double")
    poly = spark.createDataFrame([([ring(4.0), ring(1.0)], -4.0, 4.0, -4.0, 4.0)], "rings array<array<struct<lat:double,lon:double>>>, lat_min double, lat_max double, lon_min double, lon_max double")
    assert sorted(r.id for r in spatial.in_polygon(pts, poly).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_spj15_takes_points_on_an_edge(spark, tmp_path):
    """Customer 2811 is on the border of nation 16."""
    spark.createDataFrame([(2811, 0)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert [(r.fine, r.city) for r in registry.QUERIES["spj15_admin_chain"](spark, str(tmp_path)).collect()] == [("N16", "NATION_16")]


def test_clu10_equal_distances_go_by_the_last_bit():
    """Order 41205: candidate 6 lies between the centres 1 and 4, a last bit nearer to the first."""
    rows = [(1, -50.38400000000001, -139.955, 0.44118032165524496, 4), (2, -46.184000000000005, -139.915, 0.25049139929469166, 3), (3, -48.08400000000001, -139.835, 0.16848102387622835, 3), (4, -50.08400000000001, -139.955, 0.05869173170103137, 2), (5, -48.23400000000001, -139.915, 0.054009108194239666, 3), (6, -50.23400000000001, -139.955, 0.027146415278563922, 2)]
    got = clustering.merge_sources(Group.of([dict(zip(("id", "lat", "lon", "share", "n"), r, strict=True)) for r in rows]))
    assert (6, 1, 1) in got


def test_equal_masses_are_equal_to_the_last_bit():
    """Rows 0 and 1 are near members of one weight at other places of the list: added in order they tie, in a matrix product they do not."""
    w = np.array([0.0673252731883153, 0.23723096850326422, 0.23723096850326422, 0.12164152115572424, 0.3990218203881962])
    near = np.eye(5, dtype=bool)
    near[0], near[1] = [True, True, False, True, True], [True, False, True, True, True]
    assert clustering.heaviest(near, w)(np.ones(5, bool)) == 0


def test_src18_reads_both_arrays_from_the_same_files(spark, monkeypatch):
    """Rows may come to a file in any order; numbers and vectors still belong together."""
    pack = io_queries._npz_file
    monkeypatch.setattr(io_queries, "_npz_file", lambda pdf: pack(pdf.sample(frac=1)))
    got = {r.vec_id: r.total for r in registry.QUERIES["src18_matrix_rows"](spark, SF).collect()}
    want = {r.vec_id: sum(float(x) for x in r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_vec03_keeps_its_order(spark):
    """By score, also when the join with the places sorts by id."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [r.score for r in registry.QUERIES["vec03_topk_single_query"](spark, SF).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == 20 and got == sorted(got, reverse=True)


def test_boxes_near_reaches_as_far_as_the_largest_box(spark, monkeypatch):
    """The last tier does not go round the globe, and still no pair is lost."""
    asked, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda a, b, km, **how: asked.append(km) or join(a, b, km, **how))
    pts = [(i, -80.0 + i * 0.8, -179.0 + i * 1.7) for i in range(200)]
    boxes = [(j, -70.0 + j * 2, -70.0 + j * 2 + 0.1 * (j + 1), -170.0 + j * 5, -170.0 + j * 5 + 0.1 * (j + 1)) for j in range(60)]
    got = spatial.boxes_near(spark.createDataFrame(pts, "id long, lat double, lon double"), spark.createDataFrame(boxes, "bid long, lat_min double, lat_max double, lon_min double, lon_max double"), 300.0, (60.0, 200.0))
    near = lambda lat, lon, a, z, w, e: clustering.km((lat, lon), (min(max(lat, a), z), min(max(lon, w), e))) <= 300.0
    assert sorted((r.id, r.bid) for r in got.collect()) == [(i, j) for i, lat, lon in pts for j, *b in boxes if near(lat, lon, *b)]
    assert max(asked) < 1500


def scattered(n, seed, crowd=0):
    r = np.random.default_rng(seed)
    out = [(float(a), float(o)) for a, o in zip(r.uniform(-90, 90, n), r.uniform(-180, 180, n))]
    return [(i, a, o) for i, (a, o) in enumerate(out + [(float(a), float(o)) for a, o in zip(r.normal(10, 0.1, crowd), r.normal(179.99, 0.05, crowd).clip(-180, 180))])]


def test_radius_join_does_not_broadcast_the_repeated_side(spark):
    """Either side can be repeated; the plan does not take the repeated one for small."""
    a, b = scattered(120, 1, 60), scattered(200, 2, 60)
    left, right = spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "rid long, rlat double, rlon double")
    for radius in (0.5, 40.0, 3000.0, 19000.0):
        want = sorted((i, j) for i, *p in a for j, *q in b if clustering.km(p, q) <= radius)
        for spread in ("left", "right"):
            got = spatial.radius_join(left, right, radius, spread=spread)
            assert sorted((r.id, r.rid) for r in got.collect()) == want
            assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_begins_with_a_small_ring(spark, monkeypatch):
    """Even places are served by it, crowds and deserts too; ties by id."""
    asked, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda a, b, km, **how: asked.append(km) or join(a, b, km, **how))
    a, b = scattered(150, 3, 20), scattered(3000, 4, 100)
    b += [(i + 10_000, lat, lon) for i, lat, lon in b[:50]]
    got = spatial.nearest(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "rid long, rlat double, rlon double"), "id", "rid", 5000.0, 3)
    lat, lon, ids = (np.array([x[i] for x in b], float) for i in (1, 2, 0))
    want = []
    for i, *p in a:
        far = clustering.km(p, (lat, lon))
        order = np.lexsort((ids, far.round(9)))[:3]
        want += [(i, n, int(ids[j])) for n, j in enumerate(order, 1) if far[j] <= 5000.0]
    assert sorted((r.id, r["rank"], r.rid) for r in got.collect()) == sorted(want)
    assert asked[0] < 1500 and asked[-1] == 5000.0


def test_spj05_does_not_sort_its_pairs(spark):
    plan = registry.QUERIES["spj05_big_town_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_smp08_bounds_lose_no_row(spark, monkeypatch):
    """The part looked at first changes nothing: all, a sixteenth, or none of the candidates."""
    found = []
    for share in (1, 16, 1 << 40):
        monkeypatch.setattr(rel_queries, "SHARE", share)
        found.append(sorted(tuple(r) for r in registry.QUERIES["smp08_negative_sampling"](spark, SF).collect()))
    assert found[0] and found[0] == found[1] == found[2]


def test_src11_files_grow_in_number(spark, monkeypatch):
    kept, write = [], io_queries.written
    monkeypatch.setattr(io_queries, "MAP_ROWS", 2000)
    monkeypatch.setattr(io_queries, "written", lambda df, name: kept.append(write(df, name)) or kept[-1])
    assert registry.QUERIES["src11_map_objects"](spark, SF).count() > 0
    assert kept[0].count() >= spark.read.parquet(f"{SF}/lineitem.parquet").count() // 2000


def test_bootstrap_deals_its_rows_first(spark):
    """One file is not one task: the rows are dealt before each becomes hundreds."""
    rows = spark.range(100, numPartitions=1).selectExpr("id", "id % 2 as v")
    assert "REPARTITION_BY_NUM" in evaluate.bootstrap(rows, "v", "id", 8)._jdf.queryExecution().executedPlan().toString()


def test_smp08_deals_its_candidates_first(spark):
    assert "REPARTITION_BY_NUM" in registry.QUERIES["smp08_negative_sampling"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_txt08_keeps_the_documents_where_they_are(spark):
    """No postings of common words: what is shuffled of a document is its id, and a repeated id counts once."""
    docs = spark.createDataFrame([(i % 40, "the " * 50 + ("rare bird" if i % 20 == 0 else "the  end")) for i in range(80)] + [(None, "rare bird")], "id long, norm string")
    said = spark.createDataFrame([(1, "rare bird"), (2, "the the end"), (3, ""), (4, "he end")], "pid int, phrase string")
    df = postings.document_counts(docs, said, "id", "norm")
    assert {r.token: r.df for r in df.collect()} == {"rare": 2, "bird": 2, "the": 40, "end": 38}
    got = postings.rare_first(docs, said, docs.where("id < 30").select(F.col("id").alias("doc")), "id", "norm", 10)
    assert sorted((r.pid, r.doc, r.plan) for r in got.collect()) == sorted([(1, i, "text first") for i in (0, 20)] + [(2, i, "place first") for i in range(30) if i % 20])
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_src15_finds_shards_by_blocks(spark):
    """Entries meet the shards of their own bytes, not a list of all shards."""
    shards = spark.createDataFrame([(i, 10 if i % 7 else 0) for i in range(200)], "shard int, size long")
    index = spark.createDataFrame([(0, 0, 5), (1, 8, 4), (2, 95, 30), (3, 1700, 9), (4, 1709, 1), (5, 9999, 3), (6, 0, 1710)], "id int, offset long, size long")
    got = archives.shard_pieces(index, shards)
    rows, held = got.collect(), [i for i in range(200) if i % 7]
    assert {(r.id, r["at"], r["size"]) for r in rows if r.id < 6} == {(0, 0, 5), (1, 0, 2), (1, 2, 2), (2, 0, 5), (2, 5, 10), (2, 15, 10), (2, 25, 5), (3, 0, 9), (4, 0, 1)}
    assert all(held[(off + r["at"]) // 10] == r.shard for r in rows for off in [{0: 0, 1: 8, 2: 95, 3: 1700, 4: 1709, 6: 0}[r.id]])
    assert sum(r.id == 6 for r in rows) == 171
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(__block#" in plan and "collect_list" not in plan


def _brute(q, g, k):
    """rows of (qid, vector, author) by definition."""
    out = []
    for i, v, a in q:
        scores = sorted(((-round(float(np.dot(v, w)), 12), j) for j, w, b in g if b != a and i != j))[:k]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(scores)]
    return sorted(out)


def test_vec12_close_scores_and_ties_are_exact():
    """Scores that single precision cannot tell apart, equal vectors, few items, and vectors too long for it."""
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    for scale, n in ((1.0, 300), (1e-3, 5), (1e40, 40)):
        vectors = [(base + 1e-9 * r.normal(size=8) if i % 3 else base) * scale for i in range(n)]
        rows = [(i, v, str(i % 4)) for i, v in enumerate(vectors)]
        asked = pa.table({"qid": pa.array([x[0] for x in rows]), "qvec": pa.array([list(x[1]) for x in rows]), "qauthor": pa.array([x[2] for x in rows])})
        items = asked.rename_columns(["gid", "gvec", "gauthor"])
        got = pa.Table.from_batches(list(vector._best(asked, items.to_batches(max_chunksize=70), 8, True, True)), schema=vector._BEST).to_pylist()
        found = {}
        for x in sorted(got, key=lambda x: (x["qid"], -x["score"], x["gid"])):
            found.setdefault(x["qid"], []).append(x["gid"])
        assert sorted((i, j, k + 1) for i, js in found.items() for k, j in enumerate(js)) == _brute(rows, rows, 8) if scale < 2 else len(got) == 8 * n


def test_vec10_makes_no_pairs(spark):
    """A row a query leaves a task; own rows are out, equal scores go to the smaller id, and a query without a near one has a null."""
    rows = [(0, [1.0, 0.0], 0.0, 0.0), (1, [0.5, 0.0], 0.0, 10.0), (2, [0.5, 0.0], 50.0, 10.0), (3, [0.9, 1.0], -80.0, 0.0)]
    g = spark.createDataFrame(rows, "gid long, gvec array<double>, lat double, lon double")
    q = spark.createDataFrame(rows, "qid long, qvec array<double>, qlat double, qlon double").where("qid <> 1")
    got = {r.qid: tuple(r)[1:] for r in vector.best_and_near(q, g, 2000.0).collect()}
    assert got == {0: (3, 0.9, 1, 0.5), 2: (0, 0.5, 0, None), 3: (0, 0.9, 0, None)}
    assert vector.best_and_near(q, g.where("gid = 0"), 2000.0).count() == 2


def test_spj22_finds_pairs_beyond_the_tiles_and_over_the_pole(spark, monkeypatch):
    customers = spark.createDataFrame([(1, 87.0, 10.0), (2, 0.0, 179.9), (3, -87.0, 0.0)], "c_custkey long, lat double, lon double")
    suppliers = spark.createDataFrame([(5, 86.5, -170.0), (6, 0.5, -179.9), (7, -70.0, 0.0)], "s_suppkey long, rlat double, rlon double")
    monkeypatch.setattr(geo_queries, "points", lambda s, d, table, *more: customers if table == "customer" else suppliers)
    assert sorted(map(tuple, registry.QUERIES["spj22_tile_cover"](spark, "").collect())) == [(1, 5), (2, 6)]


def test_src20_ends_with_the_ring_that_serves_everybody(spark, monkeypatch):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "a long, lat double, lon double")
    right = spark.createDataFrame([(i, 10.0 * (i % 2) + i * 1e-3, 10.0 * (i % 2)) for i in range(2000)], "b long, rlat double, rlon double")
    calls, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda *a, **k: calls.append(1) or join(*a, **k))
    got = sorted((r.a, r.b, r["rank"]) for r in spatial.nearest(left, right, "a", "b", 15000.0, 2).collect())
    assert got == [(1, 0, 1), (1, 2, 2), (2, 1, 1), (2, 3, 2)] and len(calls) == 1


def test_grf03_searches_only_for_the_nodes_it_reaches(spark, monkeypatch):
    """Of no node are the nearest looked for twice, and not of those that no weight comes to."""
    asked, search = [], vector.nearest

    def seen(queries, *more, **how):
        asked.extend(r.qid for r in queries.select("qid").collect())
        return search(queries, *more, **how)

    monkeypatch.setattr(vector, "nearest", seen)
    assert registry.QUERIES["grf03_ppr_3_steps"](spark, SF).count() == 200
    assert len(asked) == len(set(asked)) < spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_limit_edges_reads_its_edges_once(spark):
    edges = spark.createDataFrame([(1, 2, 0.5, 9), (1, 3, 0.3, 1), (1, 4, 0.2, 9), (2, 1, 1.0, 1)], "src long, dst long, w double, km int")
    got = graph.limit_edges(edges, F.col("km") > 5)
    assert sorted((r.src, r.dst, round(r.w, 9)) for r in got.collect()) == [(1, 1, 0.7), (1, 3, 0.3), (2, 1, 1.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + got._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_pairs_of_blocks_are_dealt_one_to_a_partition(spark):
    of = vector._one_each(spark, 25)
    got = spark.createDataFrame([(x,) for x in of], "x int").repartition(25, "x").select(F.spark_partition_id().alias("p")).distinct().count()
    assert len(set(of)) == got == 25


def test_nearest_is_the_same_whichever_side_is_shipped(spark, monkeypatch):
    """Many queries with the gallery shipped, few with the queries shipped, and both in blocks; guard and own id, equal vectors, tiles that are not full."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((700, 8))
    v[300:320] = v[0]
    e = spark.createDataFrame([(i, x.tolist(), str(i % 7)) for i, x in enumerate(v)], "id long, v array<double>, a string")
    queries, gallery = e.selectExpr("id qid", "v qvec", "a qauthor"), e.selectExpr("id gid", "v gvec", "a gauthor")
    score = np.where(np.arange(700)[:, None] % 7 == np.arange(700)[None, :] % 7, -np.inf, (v @ v.T).round(12))
    want = {(i, int(j), r + 1) for i in range(700) for r, j in enumerate(np.lexsort((np.arange(700), -score[i]))[:8])}
    for rows, tile, size in ((2048, 256, 64 << 20), (64, 16, 64 << 20), (64, 16, 8 * 8 * 200)):
        monkeypatch.setattr(vector, "ROWS", rows)
        monkeypatch.setattr(vector, "TILE", tile)
        monkeypatch.setattr(vector, "QUERY_BYTES", size)
        assert {(r.qid, r.gid, r["rank"]) for r in vector.nearest(queries, gallery, 8, guard=True, own=True).collect()} == want
