import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from cases import ODD
from pyspark.sql import functions as F

import corpus_pipeline
from stratalens.llm import common, exact_dedup, language, media, packing, quality, simhash
from stratalens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_language(spark, odd, odd_extra, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) for r in got)
    test = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    rows = {r.doc_id: r for r in language.predict(odd_extra, model).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[10].lang_pred == "und"
    assert language.predict(none, model).count() == 0
    empty = language.train(none)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    kept = language.keep_known(odd_extra, model)
    assert kept.columns == odd_extra.columns and 3 not in {r.doc_id for r in kept.collect()}


def brute_language(rows, tests):
    """Prototypes and cosines from the definition, a trigram and a language at a time."""

    def vector(c):
        return np.random.default_rng([language.SEED, ord(c) if c != " " else 0]).integers(0, 2, language.DIMENSIONS, np.int8).astype(int) * 2 - 1

    def bundle(text):
        s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        s = re.sub(" +", " ", s)
        total = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(s, s[1:], s[2:]):
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        return total

    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    sums = {}
    for i, lang, text in rows:
        if lang is not None and i is not None and not held(i):
            sums[lang] = sums.get(lang, 0) + np.rint(unit(bundle(text or "")) * 10_000)
    out = []
    for text in tests:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        cosine = {lang: round(float(unit(bundle(text)) @ unit(v)), 6) for lang, v in sums.items()}
        out.append(min(((lang, min(1, max(0, x))) for lang, x in cosine.items()), key=lambda p: (-cosine[p[0]], p[0])))
    return out


def test_language_against_brute_force(spark, frame):
    """With a rare language, one learned from a single row, a tie of two languages, and odd texts."""
    words = {"xx": "zorp blick vanth", "yy": "mala kero tiso", "aa": "ünder straße gehen", "bb": "ünder straße gehen"}
    r = random.Random(8)
    rows = [(i, lang, " ".join(r.choice(words[lang].split()) for _ in range(12))) for i, lang in enumerate(["xx"] * 30 + ["yy"] * 4)]
    rows += [(200, "aa", words["aa"]), (201, "bb", words["bb"]), (202, None, "zorp"), (None, "cc", "zzz"), (203, "zz", "日本語の文")]
    rows = [x for x in rows if x[0] is None or x[0] < 200 or not held(x[0])] + [(i, "zz", "日本語の文") for i in range(300, 302)]
    model = language.train(frame([(i, t, lang, "s", 1) for i, lang, t in rows]))
    assert model.languages == tuple(sorted({lang for i, lang, _ in rows if lang and i is not None and not held(i)}))
    assert "cc" not in model.languages and {"xx", "yy", "aa", "bb", "zz"} >= set(model.languages)
    tests = ["zorp vanth", "kero mala", "gehen ünder", "日本語", "qqq", "", None, "12 !", "a"] + [t for *_, t in rows]
    got = language.predict(frame([(i, t, None, None, None) for i, t in enumerate(tests)]), model).orderBy("doc_id").collect()
    for g, (lang, x) in zip(got, brute_language(rows, tests), strict=True):
        assert g.lang_pred == lang and g.score == pytest.approx(x, abs=1e-5)
    assert got[2].lang_pred == "aa"  # a tie goes to the first by name


def test_every_language_is_learned(frame):
    names = [f"l{k:03d}" for k in range(300)]
    rows = [(i, f"w{n} x{n} " * 3, n, "s", 1) for i, n in enumerate(names * 3)]
    learned = {n for i, n in enumerate(names * 3) if not held(i)}
    assert set(language.train(frame(rows)).languages) == learned and len(learned) > 256


def test_trigram_bundles_are_sums_of_bound_vectors():
    space = language.Space(64)
    text = "abra cad"
    grams = language.trigrams(text)
    assert len(grams) == 8  # _ab abr bra ra_ a_c _ca cad ad_
    whole = space.bundle([text, ""])
    assert np.array_equal(whole[0], sum(space.bound(grams[i : i + 1])[0].astype(np.float32) for i in range(len(grams))))
    assert not whole[1].any()


def test_quality(spark, odd_extra, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in test]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert quality.score(odd_extra, model).count() == len(ODD)
    assert quality.score(none, model).count() == 0
    assert quality.keep_good(odd_extra, model).columns == odd_extra.columns


def test_tiny_samples_give_a_score():
    """The trainer would end the process on these."""
    for good, bad in ((["x"] * 20, ["y"] * 20), ([""] * 20, ["y"] * 20), ([""] * 20, [""] * 20), (["ab"] * 16, ["a" * 9000] * 16)):
        score = quality.fit(good, bad).scorer()
        assert all(0 <= score(t) <= 1 for t in ("", "x", "y" * 9000, good[0]))


def test_a_dictionary_in_batches_reads_all():
    texts = [f"{w} is the word of text number {i} and of no other".encode() for i, w in enumerate("abcdefghij" * 300)]
    whole, parted = quality.dictionary(texts, 4096), quality.dictionary(texts, 4096, 40_000)
    for d in (whole, parted):
        size, plain = quality._sizer(d), quality._sizer(b"\n" * 16)
        assert size(texts[5]) < plain(texts[5])


def brute_quality(model, text):
    """From the definition: frames compressed one by one with each dictionary."""
    raw = (text or "").encode()

    def size(data):
        d = zstandard.ZstdCompressionDict(data)
        frames = [raw[a : a + 4096] for a in range(0, len(raw), 4096)] or [b""]
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(f)) for f in frames)

    g, b, n = size(model.good), size(model.bad), len(raw)
    x = (1, 20 * (b - g) / (n + 20), (b - g) / math.sqrt(n + 20), math.log((g + 4) / (n + 20)))
    return 1 / (1 + math.exp(-max(-30, min(30, sum(w * v for w, v in zip(model.weights, x, strict=True))))))


def test_quality_against_brute_force(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    # What train learns on executors is what fit learns from the same rows in the same order.
    q = {r.doc_id: r.quality for r in labels.where(~common.held_out()).collect() if r.doc_id in texts}
    order = [r.doc_id for r in labels.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").collect()]
    again = quality.fit(*[[texts[i] for i in order if q.get(i) == k] for k in (1, 0)])
    assert (again.good, again.bad, again.prior) == (model.good, model.bad, model.prior)
    assert np.allclose(again.weights, model.weights, rtol=1e-6)
    for r in quality.score(docs, model).collect():
        assert r.score == pytest.approx(brute_quality(model, texts[r.doc_id]), rel=1e-9)
    want = sorted((round(brute_quality(model, t), 9) for _, t, *_ in ODD))
    assert sorted(round(r.score, 9) for r in quality.score(odd, model).collect()) == want


def test_long_labelled_texts_are_learned_from(spark, frame):
    """No labelled text is passed over for its length."""
    long = [(i, ("good words here " if i % 2 else "BAD STUFF! ") * 9000, "en", "a", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.train(frame(long), labels)
    assert model.good and b"good words" in model.good + model.bad
    got = {r.doc_id: r.predicted for r in quality.score(frame(long), model).collect()}
    assert got == {i: i % 2 for i in range(60)}


def test_quality_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.train(odd, labels)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.score(odd, quality.train(odd, one)).collect()} == {1}


def test_pipeline_against_brute_force(spark):
    """Every stage on its own input, decisions worked out row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "exact dedup", "near dedup", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    q = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    left = {i: t for i, t in texts.items() if q(t) >= 0.3}
    predict = language.train(docs).predictor()
    said = dict(zip(left, predict(list(left.values())), strict=True))
    left = {i: t for i, t in left.items() if said[i][0] != "und" and said[i][1] >= language.FAR}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    fps = {i: simhash.fingerprint(t) for i, t in left.items()}
    ids = sorted(left)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= 4):
            x, y = find(i), find(ids[k + 1 + j])
            root[max(x, y)] = min(x, y)
    left = {i: left[i] for i in ids if find(i) == i}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(left)
    assert sum(r.length for r in got) >= len(left)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, name):
    """Every registered function over its whole table, held against its SQL where it has one."""
    sf = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf).toPandas()
    source = "pages" if name.startswith("op1_") else "documents"
    assert len(got) >= spark.read.parquet(f"{sf}/{source}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.sql(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda f: sorted(map(tuple, f[columns].itertuples(index=False)), key=repr)
        assert rows(got) == rows(want)


def test_op3_returns_the_stored_files(spark):
    got = QUERIES["op3_telephony_media"](spark, "/root/testdata/sf0.001").collect()
    for r in got:
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and hashlib.sha256(r.pcm).hexdigest() == r.pcm_sha256
        tag, rate, samples = media.read_wave(bytes(r.pcm))
        assert (tag, rate, len(samples)) == (media.PCM, 16000, 4 * r.payload_bytes)


def test_written_tables_are_this_runs_own(spark):
    """Intermediate tables lie in one folder a run, below the shared one; what is not needed again goes at once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    here = common.run_dir(spark)
    assert here.startswith(common.shared_dir(spark))
    one = common.written(docs, "some")
    assert one._written.startswith(here) and one.count() == docs.count()
    common.forget(one)
    assert not os.path.exists(one._written.removeprefix("file://").removeprefix("file:"))
