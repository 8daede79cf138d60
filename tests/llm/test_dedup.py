import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from cases import ODD
from pyspark.sql import functions as F

from stratalens.llm import components, exact_dedup, simhash


def brute_exact(rows):
    norm = [hashlib.sha256(re.sub(r"[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest() for _, t, *_ in rows]
    groups = {}
    for (i, *_), h in zip(rows, norm, strict=True):
        groups.setdefault(h, []).append(i)
    least = {h: min((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    return [(i, least[h], len(groups[h]), h) for (i, *_), h in zip(rows, norm, strict=True)]


@pytest.mark.parametrize("source", ["odd", "odd_extra"])
@pytest.mark.parametrize("history", ["none", "all", "some", "default"])
def test_exact(request, source, history):
    docs = request.getfixturevalue(source)
    batch = {"none": F.lit(False), "all": F.lit(True), "some": F.col("doc_id") % 2 == 0, "default": None}[history]
    got = exact_dedup.exact_dedup(docs, batch).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == sorted(brute_exact(ODD), key=repr)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_keep_first_keeps_columns(odd_extra):
    kept = exact_dedup.keep_first(odd_extra)
    assert kept.columns == odd_extra.columns
    found = brute_exact(ODD)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({h: k for _, k, _, h in found}.values())


def test_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_first(none).count() == 0
    assert simhash.groups(none).count() == 0


def test_string_ids(spark):
    rows = [("b", "one  two"), ("a", "one two"), ("c", "three"), (None, "three"), ("a", "one two")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()), key=repr)
    assert got == sorted([("b", "a", 3), ("a", "a", 3), ("a", "a", 3), ("c", "c", 2), (None, "c", 2)], key=repr)
    assert sorted(r.doc_id for r in exact_dedup.keep_first(docs).collect()) == ["a", "c"]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == ["a", "c"]


def test_keep_one_goes_by_row(spark):
    """An id shared by unlike texts loses none of them, and every group keeps one row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a + " a59"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, c, 5), (7, c + " ", 6), (None, b, 7), (None, "only null", 8), (None, "only null", 9), (3, near, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    linked = (simhash.fingerprint(a) ^ simhash.fingerprint(near)).bit_count() <= 4
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r[0], r[1]) for r in kept.collect()), key=repr)
    assert [x for x in got if x[0] == 5] == [(5, b)]
    assert len([x for x in got if x[0] == 7]) == 1 and len([x for x in got if x[0] is None]) == 1
    assert len([x for x in got if x[0] == 3]) == (1 if linked else 2)
    assert len(got) == 4 + (not linked)


def test_perfect_hash():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, (5000, 4)).astype("<u8")
    f = exact_dedup.PerfectHash.unpacked(exact_dedup.PerfectHash.build(keys).packed())
    assert sorted(f.slots(keys).tolist()) == list(range(5000))
    others = f.slots(r.integers(0, 1 << 63, (1000, 4)).astype("<u8"))
    assert others.max() < 5000 and others.min() >= -1


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_keep_first_with_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (1, "x", 3)], "doc_id long, text string, `a.b` int")
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, fps[i], least.get(find(i))) for i, k in enumerate(ids)]


@pytest.mark.parametrize("source", ["odd", "odd_extra"])
def test_simhash_groups(request, source):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(request.getfixturevalue(source)).collect()]
    want = brute_components([brute_fingerprint(t) for _, t, *_ in ODD], [i for i, *_ in ODD])
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_covering_masks_miss_no_pair():
    masks = simhash.masks()
    assert len(masks) == 31
    r = random.Random(2)
    for _ in range(4000):
        difference = sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        assert any(not difference & m for m in masks)


@pytest.mark.parametrize("small", [2, 1024])
def test_links_of_dense_and_sparse_fingerprints(spark, small):
    """A tight ball (large buckets, also by the midpoint way), a chain and strangers."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(60)}
    chain = r.getrandbits(64)
    for _ in range(20):
        fps.add(chain)
        chain ^= sum(1 << b for b in r.sample(range(64), r.randint(2, 5)))
    fps |= {r.getrandbits(64) for _ in range(40)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(simhash.links(df, small=small)).collect()}
    want = brute_components(fps, list(range(len(fps))))
    same = lambda labels: sorted(sorted(k for k in fps if labels[k] == v) for v in set(labels.values()))
    assert same({x: found.get(x, x) for x in fps}) == same({f: c for _, f, c in want})


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)], "u long, v long")
    got = components.components(edges).collect()
    assert len(got) == n and {r.root for r in got} == {0}
