"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 4-word shingles (repeats included;
fewer words are one shingle; none is fingerprint zero), XXH64 with seed 42 of each, and a bit set
where more than half of the hashes set it.

Links: two fingerprints with at most ``RADIUS`` differing bits.  Each bit position gets a vector
of ``RADIUS + 1`` bits; table ``t`` (any nonzero such vector) keeps the positions whose vector has
an odd product with ``t``.  The vectors of at most RADIUS differing positions span less than the
whole space, so some ``t`` is orthogonal to all of them: that table masks out every difference and
the pair meets there (Pagh, "CoveringLSH").  31 tables of about 32 bits each, no pair missed.

Only distinct fingerprints are compared, with the least doc_id of each.  A bucket of up to
``SMALL`` fingerprints is compared within itself and gives a forest (fewer edges than members).
A larger bucket takes another exact way: fingerprints at distance <= RADIUS share a point within
RADIUS / 2 of both, so each is joined to the points around it (flips among the bits its table
leaves free), and points are grouped; rows grow linearly with the bucket.

Defined cases: null text is empty text; all documents without words form one group; null doc_id
rows get fingerprints and link, but an id is "smallest" only if not null (a group of null ids
only has a null component_id); repeated rows are kept, a result row each (``keep_one`` keeps one
row a group, also of rows that share an id); other input columns are ignored, or carried through
when filtering; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import arrow_batch, forget, keep_rows, parts, table, text_or_empty, written
from stratalens.llm.components import components

SHINGLE, SEED, RADIUS, SMALL = 4, 42, 4, 1024
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_AT_ONCE = 1 << 17


def hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """The shingle hashes of a whole text, in order."""
    words = _WORDS.findall(text.encode().translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.r_[0, ends[: n - 1] + 1].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def votes(found: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit, bit 0 first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), _AT_ONCE):
        bits = np.unpackbits(found[at : at + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str) -> int:
    found = hashes(text)
    return int(_BIT[votes(found) * 2 > len(found)].sum(dtype=np.uint64)) if len(found) else 0


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks: position i has vector 1 + i mod (2^(radius+1) - 1), so all vectors are used evenly."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & t).count("1") % 2) for t in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(text_col: str = "text") -> Column:
    """SHA-256 of the text as it is; null is empty."""
    return F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """(doc_id, fp), fp as a signed long; ``with_key`` adds the text's key."""
    id_type = docs.schema[id_col].dataType
    key = [text_key(text_col).alias("key")] if with_key else []

    def run(batches):
        for batch, texts in parts(batches, "text"):
            out = pa.schema([batch.schema.field(0), ("fp", pa.int64()), *list(batch.schema)[2:]])
            yield arrow_batch(out, [batch.column(0), [_signed(fingerprint(t)) for t in texts], *batch.columns[2:]])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *key)
    return picked.mapInArrow(run, f"doc_id {id_type.simpleString()}, fp long" + (", key binary" if with_key else ""))


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the first (in the given order) of its component under ``radius``, within one small bucket."""
    bits = fps.view(np.uint64)  # bitwise_count takes the magnitude of signed numbers
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        nxt = np.where(near, label[None, :], len(fps)).min(axis=1)
        nxt = nxt[nxt]
        if (nxt == label).all():
            break
        label = nxt
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def _bucket_edges(radius: int, small: int, table_masks: list[int]):
    """Rows (t, fp) sorted by (t, masked fp) to edges (t, u, v); rows of larger buckets come out as (t, fp, null)."""
    mask = np.array([_signed(m) for m in table_masks], np.int64)
    schema = pa.schema([("t", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])

    def emit(t, u, v):
        return arrow_batch(schema, [np.asarray(t, np.int32), np.asarray(u, np.int64), v])

    def run(batches):
        kept_t, kept_fp, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in _with_end(batches):
            if batch is None:
                t, fp, final = kept_t, kept_fp, True
            else:
                t = np.r_[kept_t, batch.column(0).to_numpy().astype(np.int64)]
                fp, final = np.r_[kept_fp, batch.column(1).to_numpy()], False
            if not len(t):
                continue
            key = fp & mask[t]
            new = np.r_[True, (key[1:] != key[:-1]) | (t[1:] != t[:-1])]
            at = np.flatnonzero(new)
            size = np.diff(np.r_[at, len(t)])
            stop = len(at) if final else len(at) - 1
            out_t, out_u, out_v = [], [], []
            for i in np.flatnonzero(size[:stop] > 1).tolist():
                a, b = at[i], at[i] + size[i]
                if (over is not None and i == 0 and over == (int(t[a]), int(key[a]))) or size[i] > small:
                    yield emit(t[a:b], fp[a:b], pa.nulls(b - a, pa.int64()))
                    continue
                u, v = forest(fp[a:b], radius)
                out_t.append(np.full(len(u), t[a])), out_u.append(u), out_v.append(v)
            if stop and over is not None and size[0] == 1 and over == (int(t[0]), int(key[0])):
                yield emit(t[:1], fp[:1], pa.nulls(1, pa.int64()))
            if out_t:
                yield emit(np.concatenate(out_t), np.concatenate(out_u), np.concatenate(out_v))
            if final:
                break
            a = at[-1]
            same = over is not None and over == (int(t[a]), int(key[a]))
            if same or len(t) - a > small:  # the last bucket is large already: pass its rows on, keep none
                over = (int(t[a]), int(key[a]))
                yield emit(t[a:], fp[a:], pa.nulls(len(t) - a, pa.int64()))
                kept_t, kept_fp = t[:0], fp[:0]
            else:
                over = None
                kept_t, kept_fp = t[a:], fp[a:]

    return run


def _with_end(batches):
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect exactly what distances up to ``radius`` connect."""
    spark = distinct.sparkSession
    all_masks = masks(radius)
    literal = F.array(*[F.lit(_signed(m)) for m in all_masks])
    rows = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(len(all_masks) - 1))).alias("t"), "fp")
    key: Column = F.col("fp").bitwiseAND(F.element_at(literal, F.col("t") + 1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, F.col("t"), key).sortWithinPartitions("t", key)
    found = written(dealt.mapInArrow(_bucket_edges(radius, small, all_masks), "t int, u long, v long"), "links")
    large = found.where("v is null").select("t", F.col("u").alias("fp"))
    out = found.where("v is not null").select("u", "v")
    if not large.isEmpty():
        out = out.union(_around(large, radius, all_masks))
    out._written = found._written
    return out


def _around(large: DataFrame, radius: int, all_masks: list[int]) -> DataFrame:
    """Edges of large buckets through shared midpoints: fingerprint to the least fingerprint at each point.

    A pair within ``radius`` has a point within ceil and floor of half its distance of the two, and
    all differing bits are free in the table where they meet, so flips among the free bits suffice.
    """
    half = radius // 2
    free = [[i for i in range(64) if not m >> i & 1] for m in all_masks]
    flips = []
    for positions in free:
        one = [1 << i for i in positions]
        sets = [0, *one]
        if half >= 2:
            sets += [a | b for k, a in enumerate(one) for b in one[k + 1 :]]
        flips.append(np.array([_signed(x) for x in sets], np.int64))
    if radius % 2 or half > 2:
        raise ValueError("the midpoint way is written for radius 2 and 4")
    out = pa.schema([("t", pa.int32()), ("p", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                t, fp = batch.column(0).to_numpy()[a : a + 64], batch.column(1).to_numpy()[a : a + 64]
                p = [x ^ flips[k] for x, k in zip(fp, t, strict=True)]
                n = [len(x) for x in p]
                yield arrow_batch(out, [np.repeat(t, n), np.concatenate(p), np.repeat(fp, n)])

    # The bucket is known from t and the point (flips leave the masked bits alone).  A point's members
    # hang on the least of them; the first aggregation is partial before its shuffle.
    points = large.repartition("fp").mapInArrow(run, "t int, p long, fp long")
    least = points.groupBy("t", "p").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m <> x")
    return points.join(least.hint("shuffle_hash"), ["t", "p"]).where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct()


def groups(docs: DataFrame, radius: int = RADIUS, small: int = SMALL, **how) -> DataFrame:
    """(doc_id, fp, component_id, keep_fp) for every row; component_id is the least doc_id reachable over links, keep_fp the least fp that has it there."""
    fps = written(fingerprints(docs, **how), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp"))
    distinct = fps.groupBy("fp").agg(least.alias("least"))
    linked = links(distinct.select("fp"), radius, small)
    member = components(linked)
    # Every member of a component with its least doc_id: the minimum is combined before the shuffle,
    # and written, so that the join back can split a component with very many members.
    named = distinct.join(member, distinct.fp == member.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = written(named, "members")
    ids = written(named.groupBy("root").agg(F.min("least").alias("w")).select("root", F.col("w.doc_id").alias("component_id"), F.col("w.fp").alias("keep_fp")), "component-ids")
    lookup = written(named.join(ids.hint("shuffle_merge"), "root").select("fp", "component_id", "keep_fp"), "components")
    forget(linked, named, ids)
    return fps.join(lookup.hint("shuffle_merge"), "fp").select("doc_id", "fp", "component_id", "keep_fp", *(["key"] if "key" in fps.columns else []))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group, with all its columns: the least doc_id (null ids last), then the least fingerprint, then the least text key; of rows equal in these, any one."""
    found = groups(docs, radius, with_key=True)
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp")))
    alike = own.groupBy("doc_id", "fp", "key").agg(F.count("*").alias("n"))
    winners = alike.groupBy("doc_id", "fp").agg(F.min(F.struct("key", "n")).alias("w")).select("doc_id", "w.key", "w.n")
    return keep_rows(docs, text_key(), written(winners, "winners"))


def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
