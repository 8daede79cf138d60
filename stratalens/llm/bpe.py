"""BPE encoding and decoding through a table of distinct words.

Encoding, for any corpus size:

1. Split every text into words and count distinct words (each task combines its own words first;
   then a grouped sum).
2. Encode each distinct word once: the word table (word, ids).
3. Join ids back by position.  The most frequent words (``HEAD`` rows, each at most 64 bytes: a
   fixed bound) are joined by a broadcast map while the text is split again; the rest of a
   document's words leave as (block, place, position, word), meet the word table by a shuffle
   join, and come back to their document, grouped by block.
4. Documents wait for their words in a written table bucketed by block, so that they are not
   shuffled themselves: only rare words travel.

Decoding joins ids to pieces: the tokens of a batch of documents, numbered by position, meet the
id-to-piece table (one row a vocabulary entry, fixed size) in an Arrow hash join; put back into
position order, the joined pieces are the documents' bytes one after the other.

Defined cases: null text is empty and has no ids; repeated or null doc_id rows are each encoded;
other columns are ignored; empty tables give empty results; special-token strings inside a
text become their id, as the library does; ids unknown to the vocabulary decode to nothing.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.bytebpe import loaded, read_spec
from stratalens.llm.common import arrow_batch, forget, parts, run_dir, table, written

HEAD, HEAD_BYTES, FLUSH = 400_000, 64, 400_000
BLOCK_DOCS, BLOCK_CHARS = 4000, 8 << 20
TOKENS = 1 << 20  # joined to pieces at once
#: Ids that wait are most of the disk; a higher level takes a tenth off them for little time.
ZSTD_LEVEL = "parquet.compression.codec.zstd.level"


def distinct_words(texts: DataFrame, spec) -> DataFrame:
    """(word, n) of all words of column ``text``."""

    def run(batches):
        bpe, seen = loaded(spec.value), Counter()
        out = pa.schema([("word", pa.string()), ("n", pa.int64())])

        def flush():
            words = list(seen)
            for a in range(0, len(words), 20_000):
                yield arrow_batch(out, [words[a : a + 20_000], [seen[w] for w in words[a : a + 20_000]]])
            seen.clear()

        for _, some in parts(batches, "text"):
            for text in some:
                for i, part in enumerate(bpe.segments(text)):
                    if not i % 2:
                        seen.update(bpe.split(part))
                if len(seen) > FLUSH:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(words: DataFrame, spec) -> DataFrame:
    """(word, n, ids): each distinct word encoded once; ids packed little-endian."""

    def run(batches):
        bpe = loaded(spec.value)
        out = pa.schema([("word", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])
        for batch, some in parts(batches, "word", 8192):
            yield arrow_batch(out, [batch.column(0), batch.column(1), [bpe.word_ids(w) for w in some]])

    return written(words.mapInArrow(run, "word string, n long, ids binary"), "word-table")


def _head(words: DataFrame, most: int, most_bytes: int) -> dict[str, bytes]:
    """The most frequent words, at most ``most`` of at most ``most_bytes`` each."""
    short = words.where(F.octet_length("word") <= most_bytes)
    if short.count() > most:
        n = F.col("n")
        # The count above which fewer than `most` words lie, from the counts' own histogram.
        by_n = short.groupBy("n").agg(F.count("*").alias("words")).orderBy(n.desc()).limit(100_000).toLocalIterator()
        total, least = 0, None
        for r in by_n:
            total += r["words"]
            if total > most:
                break
            least = r["n"]
        short = short.where(n >= least) if least is not None else short.where(F.lit(False))
    got = short.select("word", "ids").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def _held(texts: DataFrame, spec, top, id_type: str) -> DataFrame:
    """A written table, bucketed by block, of every document with its head words' ids in place.

    A block is a run of documents of one task with little text, so it fits in memory anywhere.
    """
    fields = f"doc_id {id_type}, block long, place int, done binary, pos array<int>, words array<string>"

    def split(batches):
        from pyspark import TaskContext

        bpe, found, block = loaded(spec.value), top.value, TaskContext.get().partitionId() << 32
        chars = docs = 0
        for batch, some in parts(batches, "text"):
            blocks, places, done, where, rare = [], [], [], [], []
            for text in some:
                if docs and (docs >= BLOCK_DOCS or chars + len(text) > BLOCK_CHARS):
                    block, docs, chars = block + 1, 0, 0
                ids, at, missing, size = [], [], [], 0
                for i, part in enumerate(bpe.segments(text)):
                    if i % 2:
                        ids.append(bpe._special_bytes[part])
                        size += len(ids[-1])
                        continue
                    words = bpe.split(part)
                    got = [found.get(w) for w in words]
                    for k, g in enumerate(got):
                        if g is None:
                            at.append(size)
                            missing.append(words[k])
                            got[k] = b""
                        else:
                            size += len(g)
                    ids += got
                blocks.append(block), places.append(docs), done.append(b"".join(ids)), where.append(at), rare.append(missing)
                docs, chars = docs + 1, chars + len(text)
            out = pa.schema([batch.schema.field(0), ("block", pa.int64()), ("place", pa.int32()), ("done", pa.binary()), ("pos", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])
            yield arrow_batch(out, [batch.column(0), blocks, places, done, where, rare])

    spark = texts.sparkSession
    name = f"bpe_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    out = texts.mapInArrow(split, fields).write.option("compression", "zstd").option(ZSTD_LEVEL, 6).option("path", f"{run_dir(spark)}/{name}")
    out.bucketBy(buckets, "block").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files are outside the warehouse and stay for `held`
    return held


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, head: int = HEAD, finish=None, finish_fields: str = "ids array<int>") -> DataFrame:
    """(doc_id, ids) of every document.

    ``finish(bpe, packed ids of some documents) -> columns`` replaces ids by what a caller derives
    from them, with ``finish_fields`` as their Spark fields.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = word_table(distinct_words(texts.select("text"), spec), spec)
    top = spark.sparkContext.broadcast(_head(words, head, HEAD_BYTES))
    id_type = docs.schema[id_col].dataType.simpleString()
    held = _held(texts, spec, top, id_type)
    # A rare word's place is (document in the block, number in the document), packed in one long.
    slot = F.shiftleft(F.col("place").cast("long"), 32) + F.col("k")
    rare = held.where(F.size("words") > 0).select("block", "place", F.posexplode("words").alias("k", "word")).select(F.col("block").alias("of"), slot.alias("slot"), "word")
    back = written(rare.join(words.select("word", "ids").hint("shuffle_merge"), "word").select("of", "slot", "ids"), "rare-ids")
    forget(words)
    finish = finish or (lambda bpe, packed: [[np.frombuffer(x, bpe.dtype).astype(np.int32) for x in packed]])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        bpe = loaded(spec.value)
        fills = dict(zip(right.column("slot").to_pylist(), right.column("ids").to_pylist(), strict=True))
        packed = []
        for place, done, pos in zip(*(left.column(c).to_pylist() for c in ("place", "done", "pos")), strict=True):
            pieces, at = [], 0
            for k, p in enumerate(pos):
                pieces += [done[at:p], fills[place << 32 | k]]
                at = p
            packed.append(b"".join([*pieces, done[at:]]))
        names = [f.split()[0] for f in finish_fields.split(", ")]
        return pa.table([left.column("doc_id"), *finish(bpe, packed)], names=["doc_id", *names])

    waiting = held.select("doc_id", "block", "place", "done", "pos")
    return waiting.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(fill, f"doc_id {id_type}, {finish_fields}")


class Pieces:
    """The id-to-piece table: (id, piece), every vocabulary entry and special token."""

    def __init__(self, bpe):
        rows = sorted((bpe.pieces | {i: text.encode() for text, i in bpe.special.items()}).items())
        self.table = pa.table({"id": pa.array([i for i, _ in rows], pa.int32()), "piece": pa.array([b for _, b in rows], pa.binary())})

    def texts(self, ids: list[np.ndarray]) -> list[str]:
        """A text a document: its tokens joined to their pieces, in order of position, read as UTF-8; bytes that are none become U+FFFD, as the library does."""
        out: list[str] = []
        start = size = 0
        for stop, one in enumerate(ids, 1):
            size += len(one)
            if size >= TOKENS or stop == len(ids):
                out += self._join(ids[start:stop])
                start, size = stop, 0
        return out

    def _join(self, ids: list[np.ndarray]) -> list[str]:
        stops = np.cumsum([len(x) for x in ids])
        tokens = pa.table({"at": np.arange(stops[-1]), "id": np.concatenate(ids).astype(np.int32)})
        met = tokens.join(self.table, "id", join_type="left outer", use_threads=False)
        pieces = met.column("piece").combine_chunks().take(pa.array(np.argsort(met.column("at").to_numpy())))
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(pieces), 0).to_numpy())][np.r_[0, stops]].tolist()
        data = pieces.buffers()[2]
        data = data.to_pybytes() if data else b""
        return [data[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(ends)]


_PIECES: dict[int, Pieces] = {}


def pieces_of(bpe) -> Pieces:
    if id(bpe) not in _PIECES:
        _PIECES.clear()
        _PIECES[id(bpe)] = Pieces(bpe)
    return _PIECES[id(bpe)]


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, text) from ids; null ids decode to the empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces = pieces_of(loaded(spec.value))
        for batch in batches:
            out = pa.schema([batch.schema.field(0), ("text", pa.string())])
            yield arrow_batch(out, [batch.column(0), pieces.texts([np.array(x or [], np.int32) for x in batch.column(1).to_pylist()])])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {id_type}, text string")


def _digests(bpe, packed: list[bytes]) -> list[list]:
    """n_tokens, ids_sha256 and decoded_sha256 of some documents."""
    ids = [np.frombuffer(x, bpe.dtype) for x in packed]
    hexed = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return [[len(x) for x in ids], [hexed(",".join(map(str, x.tolist()))) for x in ids], [hexed(t) for t in pieces_of(bpe).texts(ids)]]


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), finish=_digests, finish_fields="n_tokens long, ids_sha256 string, decoded_sha256 string")
