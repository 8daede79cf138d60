"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A letter trigram is bound by multiplying its
letters' vectors, rolled by two, one and no places; a document bundles (adds) the vectors of
all its trigrams, with a word boundary as a letter of its own.  A language's prototype bundles
its learning documents, each scaled to one length; a document gets the language whose prototype
has the largest cosine with it.

Learning reads a bounded sample of every language: about ``SAMPLE`` rows of each (all rows of one
that has fewer), chosen by a hash of doc_id, of rows that are not held out and have a language.
What is learned is one vector a language, however many there are.  Prototypes are sums of whole
numbers, so they do not depend on partitioning.  Predicting reads every whole text, and only the
text.

Defined cases: null text and text without a letter are ``und`` with score 0, as is everything
when nothing was learned; of languages whose cosines are equal to six places the first by name is
taken; null or repeated doc_id rows are predicted each (a row with a null id is not learned from);
other columns are ignored, or carried through when filtering.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import arrow_batch, held_out, parts, table

DIMENSIONS, SEED, SAMPLE, CHUNK = 1024, 20240, 3000, 4096
#: Letter vectors that a task keeps at hand; others are made again when met.
LETTERS = 20_000
UND, FAR = "und", 0.05
BROADCAST = 100_000  # languages
_BITS = 21  # a code point

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters (general category L)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Every letter trigram of the lower-cased text as one number; runs of other characters, and both ends, are letter 0."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.where(letters()[points], points, 0)
    points = points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    return points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:]


class Space:
    """The random letter vectors, made when first met from the code point alone."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed, self.made = dimensions, seed, {}

    def _vector(self, point: int) -> np.ndarray:
        if (v := self.made.get(point)) is None:
            if len(self.made) >= LETTERS:
                self.made.clear()
            v = self.made[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return v

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Only the vectors of the letters in ``grams`` are rolled."""
        mask = (1 << _BITS) - 1
        points, back = np.unique(np.concatenate([grams >> 2 * _BITS, grams >> _BITS & mask, grams & mask]), return_inverse=True)
        rows = np.array([self._vector(p) for p in points.tolist()], np.int8).reshape(-1, self.dimensions)
        a, b, c = back.reshape(3, -1)
        return np.roll(rows, 2, 1)[a] * np.roll(rows, 1, 1)[b] * rows[c]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """A vector a text, all at once: counts of distinct trigrams times their vectors, in chunks of trigrams."""
        each = [trigrams(t) for t in texts]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        if sum(map(len, each)):
            grams, inverse = np.unique(np.concatenate(each), return_inverse=True)
            owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
            order = np.argsort(inverse, kind="stable")
            inverse, owner = inverse[order], owner[order]
            for at in range(0, len(grams), CHUNK):
                lo, hi = np.searchsorted(inverse, [at, at + CHUNK])
                width = min(CHUNK, len(grams) - at)
                counts = np.bincount(owner[lo:hi] * width + inverse[lo:hi] - at, minlength=len(texts) * width)
                out += counts.reshape(len(texts), width).astype(np.float32) @ self.bound(grams[at : at + CHUNK]).astype(np.float32)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prototypes: np.ndarray

    def predictor(self):
        space, unit = Space(), _unit(self.prototypes.astype(np.float64)).astype(np.float32) if len(self.languages) else None

        def predict(texts: list[str]) -> list[tuple[str, float]]:
            if unit is None:
                return [(UND, 0.0)] * len(texts)
            has = [bool(letters()[np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)].any()) for t in texts]
            cosine = _unit(space.bundle(texts)) @ unit.T
            best = cosine.round(6).argmax(axis=1)
            return [(self.languages[b], float(min(1.0, max(0.0, c[b])))) if h else (UND, 0.0) for h, b, c in zip(has, best, cosine, strict=True)]

        return predict


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Prototypes from rows that are not held out; what comes to the driver is a count and a vector a language."""
    spark = docs.sparkSession
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return Model((), np.zeros((0, DIMENSIONS)))
    shares = spark.createDataFrame([(r["lang"], min(1.0, sample / r["n"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(4)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.join(F.broadcast(shares) if len(counts) <= BROADCAST else shares, "lang").where(draw < F.col("share"))

    def run(batches):
        space, sums = Space(), {}
        for batch, texts in parts(batches, "text", 64):
            vectors = np.rint(_unit(space.bundle(texts)) * 10_000).astype(np.int64)
            for lang, v in zip(batch.column(0).to_pylist(), vectors, strict=True):
                sums[lang] = sums[lang] + v if lang in sums else v
        out = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("value", pa.int64())])
        for lang, v in sums.items():
            yield arrow_batch(out, [[lang] * len(v), np.arange(len(v), dtype=np.int32), v])

    sums = picked.select("lang", "text").mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():  # DIMENSIONS numbers a language
        found.setdefault(r["lang"], np.zeros(DIMENSIONS, np.int64))[r["place"]] = r["value"]
    names = tuple(sorted(found))
    return Model(names, np.array([found[n] for n in names]).reshape(-1, DIMENSIONS))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, in one pass without a shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # one vector a language
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        one = shipped.value.predictor()
        for batch, texts in parts(batches, "text", 128):
            found = one(texts)
            out = pa.schema([batch.schema.field(0), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
            yield arrow_batch(out, [batch.column(0), batch.column(1), [x for x, _ in found], [s for _, s in found]])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known (not ``und``) with at least ``least_score``, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        one = shipped.value.predictor()
        for batch, texts in parts(batches, text_col, 128):
            yield batch.filter(pa.array([lang != UND and s >= least_score for lang, s in one(texts)]))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
