"""Token counts by the whole-token shortcut.

Offline (on the driver, from the vocabulary alone) each vocabulary string that encodes alone to
exactly its own single token is proved to be a whole token.  Counting then looks every
pre-token up among those; a hit counts one, and only the rest is merged.

Defined cases: null text counts as empty and has 0 tokens; a null or repeated ``doc_id`` is kept
as it is, one result a row; other input columns are ignored, whatever their names; an empty
table gives an empty result.  A special-token string inside a text counts as its one token.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.bytebpe import ByteBpe, loaded, read_spec
from stratalens.llm.common import arrow_batch, parts, table

MOST_TOKENS = 1024


def prove_whole_tokens(bpe: ByteBpe) -> set[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as one token, themselves."""
    texts = {}
    for i, piece in bpe.pieces.items():
        try:
            texts[i] = piece.decode("utf-8")
        except UnicodeDecodeError:
            continue
    ids, words = list(texts), list(texts.values())
    encoded = bpe.library.encode_batch_fast(words, add_special_tokens=False)
    return {w for i, w, e in zip(ids, words, encoded, strict=True) if e.ids == [i] and bpe.split(w) == [w]}


class _Counts(dict):
    """Tokens of a word: 1 for proved words, else merged once and remembered for a while."""

    def __init__(self, bpe: ByteBpe, whole: set[str], most: int = 300_000):
        super().__init__(dict.fromkeys(whole, 1))
        self.bpe, self.whole, self.most = bpe, whole, most

    def __missing__(self, word: str) -> int:
        n = len(self.bpe.word_ids(word)) // self.bpe.dtype.itemsize
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        get = self.__getitem__
        n = sum(1 if i % 2 else sum(map(get, self.bpe.split(part))) for i, part in enumerate(self.bpe.segments(text)))
        if len(self) > self.most + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        return n


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle."""
    spark = docs.sparkSession
    spec = read_spec(tokenizer_path)
    bpe = ByteBpe(spec)
    shipped = spark.sparkContext.broadcast((spec, sorted(prove_whole_tokens(bpe))))  # bounded by the vocabulary
    id_type = docs.schema[id_col].dataType

    def run(batches):
        spec, whole = shipped.value
        counts = _Counts(loaded(spec), set(whole))
        for batch, texts in parts(batches, "text"):
            n = [counts.count(t) for t in texts]
            out = pa.schema([batch.schema.field(0), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
            yield arrow_batch(out, [batch.column(0), [len(t.encode()) for t in texts], n, [x > most_tokens for x in n]])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
