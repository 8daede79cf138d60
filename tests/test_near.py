"""The k nearest by blocks: crowds, deserts, poles, copies of places, both ways of meeting."""

import numpy as np
import pytest

from stratalens.operators import clustering, near
from stratalens.plans import registry
from tests.test_findings_r02 import SF, scattered


def brute(a, b, radius, k):
    lat, lon, ids = (np.array([x[i] for x in b], float) for i in (1, 2, 0))
    want = []
    for i, *p in a:
        if p[0] is None:
            continue
        far = clustering.km(p, (lat, lon))
        order = np.lexsort((ids, far.round(9)))[:k]
        want += [(i, n, int(ids[j])) for n, j in enumerate(order, 1) if far[j] <= radius]
    return sorted(want)


@pytest.mark.parametrize("points", [500_000, 700])
def test_k_nearest_is_that_of_all_pairs(spark, monkeypatch, points):
    monkeypatch.setattr(near, "POINTS", points)
    monkeypatch.setattr(near, "ASKED", 100)
    a, b = scattered(250, 3, 40), scattered(1500, 4, 200)
    b += [(i + 10_000, lat, lon) for i, lat, lon in b[:50]] + [(20_000 + i, 1.0, 2.0) for i in range(300)]
    a += [(900, 1.0, 2.0), (901, 90.0, 0.0), (902, -90.0, 10.0), (903, 0.0, 180.0), (904, 0.0, -180.0), (905, None, 1.0)]
    left, right = spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "rid long, rlat double, rlon double")
    for radius, k in ((0.5, 2), (800.0, 4), (20100.0, 3)):
        got = near.k_nearest(left, right, "id", "rid", radius, k)
        assert sorted((r.id, r["rank"], r.rid) for r in got.collect()) == brute(a, b, radius, k)
    assert near.k_nearest(left, right.limit(0), "id", "rid", 800.0, 4).count() == near.k_nearest(left.limit(0), right, "id", "rid", 800.0, 4).count() == 0


@pytest.mark.parametrize("name", ["spj02_knn_in_radius", "spj20_support_k_nearest"])
def test_no_row_for_each_pair_within_the_radius(spark, monkeypatch, name):
    """About k candidates an asked point reach Spark, whatever the radius holds."""
    rows, frame = [], type(spark.range(1))
    monkeypatch.setattr(frame, "mapInArrow", counted(rows, frame.mapInArrow))
    registry.QUERIES[name](spark, SF).count()
    assert rows and all(found <= 5 * asked for found, asked in rows)


def counted(rows, call):
    def run(df, fn, schema):
        out = call(df, fn, schema)
        rows.append((out.count(), df.count()))
        return out

    return run
