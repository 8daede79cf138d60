import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from cases import ODD

from stratalens.llm import bpe, bytebpe, packing, token_counts

TEXTS = [r[1] or "" for r in ODD]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bytebpe.default_path())


def test_encode_equals_library(library):
    own = bytebpe.ByteBpe(bytebpe.read_spec())
    r = random.Random(3)
    alphabet = "ab Z09'’–é ß\t\n\r.,!<|>sdtrevm½² \x1c\u0085日"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.ids(t).tolist() == e.ids, repr(t[:80])


def test_whole_tokens_are_proved(library):
    own = bytebpe.ByteBpe(bytebpe.read_spec())
    whole = token_counts.prove_whole_tokens(own)
    assert len(whole) > 40_000
    for w in random.Random(1).sample(sorted(whole), 300):
        assert len(library.encode(w, add_special_tokens=False).ids) == 1


@pytest.mark.parametrize("source", ["odd", "odd_extra"])
def test_counts(request, source, library):
    got = sorted(map(tuple, token_counts.count_tokens(request.getfixturevalue(source)).collect()), key=repr)
    want = []
    for i, t, *_ in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_round_trip(odd_extra, library, head):
    """With any number of words in the broadcast head."""
    how = {"finish": bpe._digests, "finish_fields": "n_tokens long, ids_sha256 string, decoded_sha256 string"}
    got = sorted(map(tuple, bpe.encode(odd_extra, head=head, **how).collect()), key=repr)
    want = []
    for i, t, *_ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_decoding_joins_every_id(library):
    own = bytebpe.ByteBpe(bytebpe.read_spec())
    pieces = bpe.pieces_of(own)
    ids = [np.array([i], np.int32) for i in range(0, library.get_vocab_size(), 97)] + [np.array([], np.int32), np.array([10**6, 5], np.int32)]
    assert pieces.texts(ids) == [library.decode(x.tolist(), skip_special_tokens=False) for x in ids]
    bpe.TOKENS, before = 3, bpe.TOKENS
    try:
        several = [own.ids(t) for t in TEXTS]
        assert pieces.texts(several) == TEXTS
    finally:
        bpe.TOKENS = before


def test_decode_inverts_encode(odd):
    back = bpe.decode(bpe.encode(odd))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([(i, t or "") for i, t, *_ in ODD], key=repr)


def check_packing(rows, lengths, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert sum(r.length for r in rows) == sum(lengths)
    return len(by_sequence)


@pytest.mark.parametrize("source", ["odd", "odd_extra"])
def test_pack(request, source, library):
    rows = packing.pack(request.getfixturevalue(source)).collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, *_ in ODD]
    n = check_packing(rows, [len(x) for x in ids])
    assert n <= -(-sum(map(len, ids)) // 2048) + 1
    for (i, *_), x in zip(ODD, ids, strict=True):
        pieces = [r for r in rows if r.doc_id == i]
        if sum(j == i for j, *_ in ODD) > 1:
            continue
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            at += r.length
        assert at == len(x)


@pytest.mark.parametrize("policy", ["norm", "dot"])
def test_plan_holds_every_capacity(policy):
    r = random.Random(5)
    histogram = defaultdict(int)
    for _ in range(4000):
        histogram[min(512, int(r.expovariate(0.01)) + 1)] += 1
    limits = packing.Limits(512, 6, 270_000, (1.0, 0.5, 0.5), policy)
    runs = packing.plan(dict(histogram), limits)
    bins = defaultdict(list)
    for length, rank, n, sequence, per, offset in runs:
        for i in range(n):
            bins[sequence + i // per].append((offset + i % per * length, length))
    placed = defaultdict(int)
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
            placed[n] += 1
        assert at <= 512 and len(places) <= 6 and sum(n * n for _, n in places) <= 270_000
    assert placed == histogram
    with pytest.raises(ValueError):
        packing.plan({600: 1}, limits)


def test_production_limits_bind_and_cost_little():
    """Many short pieces: the document capacity is met, and the sequences are about as few as by tokens alone."""
    r = random.Random(7)
    histogram = defaultdict(int)
    for _ in range(3000):
        histogram[min(2048, int(r.lognormvariate(5.5, 1.5)) + 1)] += 1
    for _ in range(200):
        histogram[r.randint(1, 12)] += 1
    limits = packing.Limits()
    assert all(limits.weights) and limits.documents < limits.tokens
    docs = defaultdict(int)
    for _, _, n, sequence, per, _ in packing.plan(dict(histogram), limits):
        for i in range(n):
            docs[sequence + i // per] += 1
    least = -(-sum(k * n for k, n in histogram.items()) // 2048)
    alone = {s + i // per for _, _, n, s, per, _ in packing.plan(dict(histogram), packing.Limits(documents=2048, weights=(1.0, 0.0, 0.0))) for i in range(n)}
    assert max(docs.values()) == limits.documents
    assert len(docs) <= 1.005 * max(least, len(alone))


def test_plan_is_as_good_as_item_by_item():
    """Runs of equal pieces give as few bins as placing each piece on its own."""
    r = random.Random(6)
    histogram = defaultdict(int)
    for _ in range(1500):
        histogram[r.randint(1, 100)] += 1
    bins: list[int] = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fits = [(b, i) for i, b in enumerate(bins) if b >= n]
            if fits:
                b, i = min(fits)
                bins[i] = b - n
            else:
                bins.append(100 - n)
    runs = packing.plan(dict(histogram), packing.Limits(100, 100, 10_000, (1.0, 0.0, 0.0)))
    used = max(s + (n - 1) // per for _, _, n, s, per, _ in runs) + 1
    assert used <= len(bins) + 1


def test_empty(none):
    assert token_counts.count_tokens(none).count() == 0
    assert packing.pack(none).count() == 0
    assert bpe.encode(none).count() == 0
