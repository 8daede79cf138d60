"""Quality by compression: zstandard dictionaries of good and bad text.

Two dictionaries are trained, one from texts labelled good and one from texts labelled bad.  A
text is compressed with each, in frames of ``FRAME`` bytes, so that in a long text the dictionary
does not give way to the text itself; the difference of the compressed sizes, normalised by the
text's size, says which dictionary knows it better.  A logistic curve over that difference (and
over the normalised size itself, see ``_features``), fitted on labelled texts that no dictionary
has seen, gives probabilities.

Fitting reads a bounded sample: at most ``SAMPLE`` labelled rows a class, in the order of a hash
of doc_id, every text whole.  Only the ids of the sample and what is learned come to the driver: a
dictionary is trained by one streaming task a class, which holds ``BATCH`` bytes of text at a time
(of more text, a dictionary is trained a batch and then one from those), and the sizes for the
curve are found where the texts are.  Scoring reads every whole text and only the text.

Defined cases: null text scores as empty text; null or repeated doc_id rows are scored each;
labels other than 0 and 1 and labels of unknown documents are ignored; with fewer than
``LEAST`` labelled texts of either class every text scores the share of label 1 among those
found (0.5 without any); a class of too little text to train on has its own text as dictionary;
other columns are ignored, or carried through when filtering.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import arrow_batch, forget, held_out, parts, table, text_or_empty, written

SAMPLE, LEAST = 4000, 8
DICTIONARY, LEVEL, THRESHOLD = 1 << 16, 3, 0.3
FRAME, BATCH = 4096, 32 << 20
#: The trainer fails hard on next to nothing, so samples have this many bytes (short texts are joined) and there are so many.
SAMPLE_BYTES, SAMPLES = 256, 16


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        if not self.good:
            return lambda text: self.prior
        size = _sizer(self.good), _sizer(self.bad)

        def score(text: str) -> float:
            z = float(np.dot(self.weights, _features(text.encode(), *size)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def _sizer(data: bytes):
    d = _dictionary(data)
    d.precompute_compress(level=LEVEL)
    c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return lambda raw: sum(len(c.compress(raw[a : a + FRAME])) for a in range(0, max(1, len(raw)), FRAME))


def _features(raw: bytes, good, bad) -> tuple[float, ...]:
    """1, the normalised difference, the difference as evidence that grows with the text, and the normalised size itself.

    The last is there for text that repeats itself: it shrinks to next to nothing under either
    dictionary, so that no difference is left to see.
    """
    n, g, b = len(raw), good(raw), bad(raw)
    return 1.0, 20 * (b - g) / (n + 20), (b - g) / math.sqrt(n + 20), math.log((g + 4) / (n + 20))


def _samples(texts: Iterable[bytes]) -> Iterator[bytes]:
    """Every byte of every text, in samples of up to FRAME bytes; short ones are joined."""
    small = b""
    for text in texts:
        for at in range(0, len(text), FRAME):
            small += text[at : at + FRAME] + b"\n"
            if len(small) >= SAMPLE_BYTES:
                yield small
                small = b""
    if small:
        yield small


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; few or small samples make a dictionary of their own content."""
    total = sum(map(len, samples))
    if len(samples) >= SAMPLES and total >= SAMPLES * SAMPLE_BYTES:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:].rjust(16, b"\n")


def dictionary(texts: Iterable[bytes], size: int = DICTIONARY, most: int = BATCH) -> bytes:
    """One dictionary of all texts, holding ``most`` bytes of them at a time."""
    trained, now, held = [], [], 0
    for sample in _samples(texts):
        now.append(sample)
        held += len(sample)
        if held >= most:
            trained.append(_train(now, size))
            now, held = [], 0
    if not trained:
        return _train(now, size)
    if now:
        trained.append(_train(now, size))
    return dictionary(trained, size, max(most, 4 * size)) if len(trained) > 1 else trained[0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on the penalised log-likelihood (the constant is not penalised)."""
    w, keep = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (p - y) + keep @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _curve(dictionaries: list[bytes], features: list[tuple[float, ...]], quality: list[int], prior: float) -> Model:
    return Model(*dictionaries, tuple(_logistic(np.array(features), np.array(quality, float))), prior)


def fit(good: list[str], bad: list[str], size: int = DICTIONARY) -> Model:
    """From labelled texts: even ones train the dictionaries, odd ones the curve.  The same as ``train`` on texts at hand."""
    n = len(good) + len(bad)
    prior = len(good) / n if n else 0.5
    if min(len(good), len(bad)) < LEAST:
        return Model(b"", b"", (), prior)
    raw = [[t.encode() for t in texts] for texts in (good, bad)]
    dictionaries = [dictionary(texts[::2], size) for texts in raw]
    sizers = [_sizer(d) for d in dictionaries]
    return _curve(dictionaries, [_features(t, *sizers) for texts in raw for t in texts[1::2]], [1] * len(raw[0][1::2]) + [0] * len(raw[1][1::2]), prior)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> Model:
    """Fit on rows that are not held out.  To the driver come at most 2 x ``sample`` ids and features, and two dictionaries."""
    spark = docs.sparkSession
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    known = labels.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("q")).distinct()
    found = docs.select("doc_id").join(known, "doc_id").distinct()
    chosen = [[r["doc_id"] for r in found.where(F.col("q") == q).orderBy(order, "doc_id").limit(sample).collect()] for q in (1, 0)]
    n = len(chosen[0]) + len(chosen[1])
    prior = len(chosen[0]) / n if n else 0.5
    if min(map(len, chosen)) < LEAST:
        return Model(b"", b"", (), prior)
    rows = [(i, q, k) for q, ids in zip((1, 0), chosen, strict=True) for k, i in enumerate(ids)]
    ids = spark.createDataFrame(rows, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, q int, k int")
    texts = written(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id").select("q", "k", "text").distinct(), "quality-sample")

    def build(batches):
        seen, parts_of = [], iter(batches)

        def stream():
            for batch in parts_of:
                seen.extend(batch.column(0).to_pylist()[:1])
                for text in batch.column(1).to_pylist():
                    yield text.encode()

        made = dictionary(stream(), size)
        if seen:
            yield arrow_batch(pa.schema([("q", pa.int32()), ("made", pa.binary())]), [seen[:1], [made]])

    made = {}
    for q in (1, 0):
        even = texts.where((F.col("q") == q) & (F.col("k") % 2 == 0)).repartition(1).sortWithinPartitions("k", "text").select("q", "text")
        made |= {r["q"]: bytes(r["made"]) for r in even.mapInArrow(build, "q int, made binary").collect()}
    dictionaries = [made[1], made[0]]

    def sizes(batches):
        sizers = [_sizer(d) for d in dictionaries]
        for batch, some in parts(batches, "text"):
            yield arrow_batch(pa.schema([("q", pa.int32()), ("k", pa.int32()), ("x", pa.list_(pa.float64()))]), [batch.column(0), batch.column(1), [list(_features(t.encode(), *sizers)) for t in some]])

    seen = texts.where("k % 2 = 1").mapInArrow(sizes, "q int, k int, x array<double>").orderBy(F.desc("q"), "k", "x").collect()
    forget(texts)
    return _curve(dictionaries, [tuple(r["x"]) for r in seen], [r["q"] for r in seen], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, in one pass without a shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        one = shipped.value.scorer()
        for batch, texts in parts(batches, "text"):
            s = [one(t) for t in texts]
            out = pa.schema([batch.schema.field(0), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
            yield arrow_batch(out, [batch.column(0), batch.column(1), s, [int(x >= threshold) for x in s]])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` predicted good, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        one = shipped.value.scorer()
        for batch, texts in parts(batches, text_col):
            yield batch.filter(pa.array([one(t) >= threshold for t in texts]))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
