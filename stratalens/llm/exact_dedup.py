"""Exact dedup against a minimal perfect hash of historical digests.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space.

1. Each row gets the SHA-256 of its normalised text and a row locator; that digest table (no
   text) is written once.
2. The historical batch is reduced to distinct digests with winner (least doc_id, then least
   locator) and count.  Per shard of the digest space a minimal perfect hash is built: cascaded
   bit arrays in which a key owns the first position that it hits alone; the rank of that bit is
   its slot.  A slot holds the full 32-byte digest and the winner's locator.
3. New rows are reduced the same way and looked up; the slot's 32 bytes are compared, so that a
   foreign digest that lands on a slot is no member.  Members take the history's winner;
   nonmembers are grouped among themselves.
4. Winners are joined back to the digest table.

Reductions combine before their shuffle and the join back has one row a digest on the other
side, so a digest shared by a third of all rows is split by adaptive execution.  A shard holds
about ``SHARD`` digests, whatever the input size.

Defined cases: null text is empty text; the least doc_id ignores nulls, and a group of null ids
only has a null keep_id; of rows that repeat the winner's id and text exactly one is kept; other
columns are ignored by ``classify`` and carried through by ``keep_first``; empty tables work as
history, as new batch, or as both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import keep_rows, table, text_or_empty, written

SHARD = 100_000
_GAMMA, _LEVELS = 2, 48


def digest(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256))


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte keys: slots 0..n-1, one a key."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.base, at = [], 0
        self.ranks = []
        for bits in levels:
            self.base.append(at)
            self.ranks.append(np.cumsum(bits) - bits)
            at += int(bits.sum())
        self.rest_base = at

    @staticmethod
    def _at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 0x9E3779B1))
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: (n, 4) little-endian words of distinct digests."""
        levels, left = [], keys
        while len(left) and len(levels) < _LEVELS:
            size = _GAMMA * len(left)
            at = cls._at(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, left[np.lexsort(left.T[::-1])] if len(left) else left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot each; for a key that was not built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._at(keys[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.base[level] + self.ranks[level][at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            where = {bytes(x): i for i, x in enumerate(np.ascontiguousarray(self.rest))}
            for i in todo:
                out[i] = where.get(bytes(np.ascontiguousarray(keys[i])), -self.rest_base - 1) + self.rest_base
        return out

    def packed(self) -> bytes:
        import json

        head = json.dumps([[len(b) for b in self.levels], len(self.rest)]).encode()
        return len(head).to_bytes(4, "little") + head + b"".join(np.packbits(b).tobytes() for b in self.levels) + np.ascontiguousarray(self.rest, "<u8").tobytes()

    @classmethod
    def unpacked(cls, blob: bytes) -> PerfectHash:
        import json

        n = int.from_bytes(blob[:4], "little")
        sizes, rest = json.loads(blob[4 : 4 + n])
        at, levels = 4 + n, []
        for size in sizes:
            k = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, k, at), count=size).astype(bool))
            at += k
        return cls(levels, np.frombuffer(blob, "<u8", rest * 4, at).reshape(-1, 4))


def _words(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row) written once; ``row`` tells repeated rows apart."""
    return written(docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def reduced(rows: DataFrame) -> DataFrame:
    """A row a digest: winner (doc_id, row) and count.  Nulls go last, so a null id wins only among nulls."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return rows.groupBy("digest").agg(first.alias("w"), F.count("*").alias("n")).select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"), "n")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, shards: int, id_type: str = "bigint") -> DataFrame:
    """(shard, hash, digests, keep_id, keep_row, n): slot i of a shard is the i-th 32 bytes and the i-th locator."""

    def build(t: pa.Table) -> pa.Table:
        words = _words(t.column("digest"))
        f = PerfectHash.build(words)
        order = np.empty(len(words), np.int64)
        order[f.slots(words)] = np.arange(len(words))
        t2 = t.take(pa.array(order))
        one = lambda c, kind: pa.array([t2.column(c).to_pylist()], pa.list_(kind))
        return pa.table([t.column("shard")[:1], pa.array([f.packed()]), pa.array([words[order].tobytes()]), one("keep_id", t.schema.field("keep_id").type), one("keep_row", pa.int64()), one("n", pa.int64())], names=["shard", "hash", "slots", "keep_id", "keep_row", "n"])

    return history.select(_shard(shards), "*").groupBy("shard").applyInArrow(build, f"shard int, hash binary, slots binary, keep_id array<{id_type}>, keep_row array<bigint>, n array<bigint>")


def lookup(new: DataFrame, index: DataFrame, shards: int, id_type: str = "bigint") -> DataFrame:
    """All distinct digests of history and new batch: (digest, keep_id, keep_row, group_size, in_history)."""

    def look(fresh: pa.Table, stored: pa.Table) -> pa.Table:
        names = ["digest", "keep_id", "keep_row", "n"]
        ids = (fresh.schema if fresh.num_rows or "keep_id" in fresh.schema.names else stored.schema).field("keep_id").type
        mine = {c: fresh.column(c).to_pylist() for c in names}
        out = {c: [] for c in [*names, "in_history"]}
        if stored.num_rows:
            slots = stored.column("slots")[0].as_py()
            held = {c: stored.column(c)[0].as_py() for c in names[1:]}
            f = PerfectHash.unpacked(stored.column("hash")[0].as_py())
            words = _words(fresh.column("digest"))
            at = f.slots(words)
            table_words = np.frombuffer(slots, "<u8").reshape(-1, 4)
            member = (at >= 0) & (table_words[np.maximum(at, 0)] == words).all(axis=1)  # the byte check
            for i in np.flatnonzero(member).tolist():
                k = int(at[i])
                held["n"][k] += mine["n"][i]
                a, b = (held["keep_id"][k], held["keep_row"][k]), (mine["keep_id"][i], mine["keep_row"][i])
                if a[0] is None and b[0] is not None or (a[0] is None) == (b[0] is None) and (a[0] is not None and b < a):
                    held["keep_id"][k], held["keep_row"][k] = b
            m = len(table_words)
            out["digest"] += [slots[32 * i : 32 * i + 32] for i in range(m)]
            for c in names[1:]:
                out[c] += held[c]
            out["in_history"] += [True] * m
            others = np.flatnonzero(~member).tolist()
        else:
            others = range(fresh.num_rows)
        for c in names:
            out[c] += [mine[c][i] for i in others]
        out["in_history"] += [False] * len(others)
        kinds = [pa.binary(), ids if not pa.types.is_list(ids) else ids.value_type, pa.int64(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(out[c], k) for c, k in zip(out, kinds, strict=True)], names=["digest", "keep_id", "keep_row", "group_size", "in_history"])

    return new.select(_shard(shards), "*").groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(look, f"digest binary, keep_id {id_type}, keep_row long, group_size long, in_history boolean")


def classify(rows: DataFrame, is_history: Column, shard_size: int = SHARD) -> DataFrame:
    """``rows`` from ``digests`` with keep_id, keep_row and group_size; ``is_history`` tells the earlier batch."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    earlier = F.coalesce(is_history, F.lit(False))
    history, new = reduced(rows.where(earlier)), reduced(rows.where(~earlier))
    shards = max(1, -(-rows.count() // shard_size))  # at most shard_size digests a shard on average
    index = written(build_index(history, shards, id_type), "digest-index")
    found = lookup(new, index, shards, id_type)
    return rows.join(found.select("digest", "keep_id", "keep_row", "group_size").hint("shuffle_merge"), "digest")


def earlier_half(rows: DataFrame) -> Column:
    """The batch split of one table: whole-number ids up to the middle of their range came earlier; of other ids a half by hash."""
    if not isinstance(rows.schema["doc_id"].dataType, T.IntegralType):
        return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if lo is None else F.col("doc_id") <= (lo + hi) // 2


def exact_dedup(docs: DataFrame, is_history: Column | None = None, **how) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, **how)
    found = classify(rows, earlier_half(rows) if is_history is None else is_history)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The staying rows of ``docs`` with all their columns.

    Rows are matched by (doc_id, digest).  Where rows repeat both, one of them stays; only those
    few go through a grouping.
    """
    rows = digests(docs)
    found = classify(rows, earlier_half(rows))
    winners = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", F.col("digest").alias("key")).agg(F.count("*").alias("n"))
    return keep_rows(docs, digest(), written(winners, "winners"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
