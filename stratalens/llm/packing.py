"""Vector best-fit packing of token sequences.

A bin (sequence) has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths).  Pieces are placed longest first; among the open bins that can take a piece
under every capacity, the one chosen has the smallest weighted norm of what would stay
(``policy="norm"``) or the largest weighted dot product of demand with residual
(``policy="dot"``, taken on the share already used, so that fuller bins win).

How it scales: all pieces of one length are alike, so bins that have taken the same lengths are
alike too.  The plan is made on the histogram of lengths (at most ``capacity`` rows, whatever the
corpus) and moves whole runs of equal bins at once; its size depends on the number of different
bin states, not on the number of pieces.  Pieces get their rank among pieces of their length
from per-block counts, without a window over a length, and (length, rank) is looked up in the
plan's runs.

Defined cases: null text is empty and packs as the single end id; null or repeated ``doc_id``
rows are packed each for itself; other input columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.llm.bytebpe import loaded, read_spec
from stratalens.llm.common import arrow_batch, parts, table, written

CAPACITY = 2048
END_ID = 0
#: Pieces are numbered within blocks of this many from one task; a block's counts have at most CAPACITY rows.
BLOCK = 50_000
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, block long, place int"


@dataclass(frozen=True)
class Limits:
    """A whole piece of ``tokens`` fills the attention capacity, so that cannot be less; a sequence takes ``documents`` pieces at most."""

    tokens: int = CAPACITY
    documents: int = 128
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    policy: str = "norm"


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, n, sequence, per, offset): pieces rank..rank+n-1 of that length, ``per`` to a sequence from ``sequence`` on, from ``offset``.

    Raises if a single piece breaks a capacity.
    """
    cap = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.int64)
    weights = np.array(limits.weights, dtype=np.float64)
    state = np.zeros((0, 3), np.int64)  # residual of each group of equal bins
    runs: list[tuple[int, int, int, int, int, int]] = []
    ranges: list[list[tuple[int, int]]] = []  # each group's sequences, as ranges
    opened = 0
    index: dict[tuple[int, int, int], int] = {}

    def put(residual: np.ndarray, given: list[tuple[int, int]]) -> None:
        nonlocal state
        key = tuple(int(x) for x in residual)
        if key in index:
            ranges[index[key]] += given
            return
        index[key] = len(ranges)
        ranges.append(list(given))
        state = np.vstack([state, residual[None]])

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens breaks a capacity")
        left, rank = histogram[length], 0
        while left:
            fits = (state >= need).all(axis=1) & np.array([bool(r) for r in ranges], dtype=bool) if len(ranges) else np.zeros(0, bool)
            if fits.any():
                scaled = (state - need) / cap
                if limits.policy == "norm":
                    score = ((weights * scaled) ** 2).sum(axis=1)
                else:
                    score = -((1 - state / cap) * (need / cap) * weights).sum(axis=1)
                score = np.where(fits, score, np.inf)
                best = int(np.flatnonzero(score == score.min())[0])
                residual, given = state[best].copy(), ranges[best]
                ranges[best] = []
            else:
                residual, given = cap.copy(), None
            per = int((residual // need).min())
            if given is None:
                n_bins = -(-left // per)
                given = [(opened, n_bins)]
                opened += n_bins
            offset, rest, done, last = limits.tokens - int(residual[0]), [], [], None
            for first, n in given:
                take = min(n, left // per)
                if take:
                    runs.append((length, rank, take * per, first, per, offset))
                    rank, left = rank + take * per, left - take * per
                    done.append((first, take))
                if take < n and left and last is None:  # the last few go to one more bin
                    runs.append((length, rank, left, first + take, left, offset))
                    last = (left, first + take)
                    rank, left, take = rank + left, 0, take + 1
                if take < n:
                    rest.append((first + take, n - take))
            if rest:
                put(residual, rest)
            if done:
                put(residual - per * need, done)
            if last:
                put(residual - last[0] * need, [(last[1], 1)])
        if len(ranges) > 4096 and sum(map(bool, ranges)) * 2 < len(ranges):  # forget emptied states
            keep = [i for i, r in enumerate(ranges) if r]
            state, ranges = state[keep], [ranges[i] for i in keep]
            index.clear()
            index.update({tuple(int(x) for x in s): i for i, s in enumerate(state)})
    return runs


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise every document once and cut only those longer than ``capacity``; the first piece takes the remainder."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    id_type = docs.schema[id_col].dataType

    def run(batches):
        from pyspark import TaskContext

        bpe, task, place = loaded(shipped.value), TaskContext.get().partitionId() << 24, 0
        for batch, texts in parts(batches, "text"):
            rows, crcs = [], []
            for i, text in enumerate(texts):
                ids = np.append(bpe.ids(text), end_id).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                at = 0
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append((i, k, at, stop - at, place))
                    crcs.append(zlib.crc32(ids[at:stop].tobytes()))
                    at, place = stop, place + 1
            of, k, at, n, places = (np.array(x) for x in zip(*rows, strict=True))
            out = pa.schema([batch.schema.field(0), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int64()), ("place", pa.int32())])
            yield arrow_batch(out, [batch.column(0).take(pa.array(of)), k.astype("i4"), at, n, crcs, task + places // BLOCK, (places % BLOCK).astype("i4")])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES.format(id=id_type.simpleString()))


def pack_pieces(cut: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Assign sequence_id and offset; ``cut`` must be a written table, as it is read three times."""
    spark = cut.sparkSession
    by_block = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `tokens` rows
    runs = plan(histogram, limits)
    shipped = spark.sparkContext.broadcast(_columns(runs))
    # Where a block's pieces of a length start: a running sum over blocks, a length at a time (one row a block).
    before = by_block.select("block", "length", (F.sum("n").over(W.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    id_type = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long"

    def place(left, right):
        """All of one block's pieces, in batches, against the block's starts."""
        first = dict(zip(*(right.column(c).to_pylist() for c in ("length", "before")), strict=True))
        order = np.argsort(left.column("place").to_numpy(), kind="stable")
        length = left.column("length").to_numpy()[order]
        by = np.argsort(length, kind="stable")
        sorted_length = length[by]
        head = np.r_[True, sorted_length[1:] != sorted_length[:-1]] if len(by) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        local = np.arange(len(by)) - np.repeat(at, np.diff(np.r_[at, len(by)]))
        rank = np.empty(len(by), np.int64)
        rank[by] = local + np.array([first[int(x)] for x in sorted_length[at]], np.int64).repeat(np.diff(np.r_[at, len(by)]))
        sequence, offset = _find(shipped.value, length, rank)
        cols = [left.column(c).take(pa.array(order)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*cols, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return cut.groupBy("block").cogroup(before.groupBy("block")).applyInArrow(place, schema)


def _columns(runs):
    """Runs sorted by (length, rank) as arrays, for searching."""
    a = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    return a


def _find(a: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = a[:, 0] * (1 << 44) + a[:, 1]
    i = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
    step = rank - a[i, 1]
    return a[i, 3] + step // a[i, 4], a[i, 5] + (step % a[i, 4]) * length


def pack(docs: DataFrame, limits: Limits = Limits(), **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(written(pieces(docs, capacity=limits.tokens, **how), "pieces"), limits)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

