"""Members of archives without unpacking them: split shards by an index, ZIP by its directory, NPZ arrays."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import ordering


def shard_pieces(index: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard, id, start, size, at): where each entry of index(id, offset, size) lies in shards(shard, size) that follow one another.

    Offsets count from the first shard's first byte.  An entry that goes on in the next shards has a
    piece in each.  Both sides are listed by blocks of bytes as long as a shard on average, an
    equi-join on the block pairs them, and a pair is made in its first common block only.
    """
    starts = ordering.summed(shards.where("size > 0"), "shard", "size", "start").withColumnRenamed("size", "shard_size")
    n, total = starts.agg(F.count("*"), F.coalesce(F.max(F.col("start") + F.col("shard_size")), F.lit(0))).first()
    step = max(1, -(-total // max(1, n)))
    block = lambda at: F.floor(at / F.lit(step))
    blocks = lambda first, last: F.explode(F.sequence(block(first), block(last))).alias("__block")
    end = F.col("start") + F.col("shard_size")
    dealt = starts.select("shard", "start", "shard_size", blocks(F.col("start"), end - 1))
    wide = F.least(F.col("offset") + F.greatest(F.col("size"), F.lit(1)), F.lit(total)) - 1
    asked = index.where((F.col("offset") >= 0) & (F.col("offset") < total)).select("id", "offset", "size", blocks(F.col("offset"), wide))
    over = (end > F.col("offset")) & (F.col("start") < F.col("offset") + F.greatest(F.col("size"), F.lit(1)))
    met = asked.join(dealt, "__block").where(over & (F.col("__block") == block(F.greatest("offset", "start"))))
    first, last = F.greatest("offset", "start"), F.least(F.col("offset") + F.col("size"), end)
    return met.select("shard", "id", (first - F.col("start")).cast("int").alias("start"), (last - first).cast("int").alias("size"), (first - F.col("offset")).alias("at"))


def sharded_members(shards: DataFrame, index: DataFrame) -> DataFrame:
    """(id, content) for index(id, offset, size) over shards(shard, content): each shard is read once, by one row, and cut there."""
    sized = shards.select("shard", F.octet_length("content").cast("long").alias("size"))
    wanted = shard_pieces(index, sized).groupBy("shard").agg(F.collect_list(F.struct("id", "start", "size", "at")).alias("pieces"))
    cut = F.transform("pieces", lambda p: F.struct(p.id.alias("id"), p["at"].alias("at"), F.substr(F.col("content"), p.start + 1, p["size"]).alias("bytes")))
    pieces = shards.join(wanted, "shard").select(F.inline(cut))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "bytes"))), F.lit(b""), lambda s, x: F.concat(s, x.bytes))
    return pieces.groupBy("id").agg(whole.alias("content"))


@dataclass(frozen=True)
class Entry:
    name: str
    method: int
    packed: int
    size: int
    crc: int
    offset: int


def zip_directory(fetch: Callable[[int, int], bytes], size: int) -> list[Entry]:
    """The entries of a ZIP of ``size`` bytes from its own directory; ``fetch(start, stop)`` gives bytes, as a ranged request does.

    Two or three requests: the end record (it lies in the last 64 KB), the wide one if that points to
    it, and the directory.
    """
    tail_at = max(0, size - 65_557)
    tail = fetch(tail_at, size)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    wide = tail.rfind(b"PK\6\7", 0, at)
    if wide >= 0 and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        where = struct.unpack_from("<Q", tail, wide + 8)[0]
        count, length, start = struct.unpack_from("<QQQ", fetch(where, where + 56), 32)
    data, out, at = fetch(start, start + length), [], 0
    for _ in range(count):
        method, crc, packed, full, names, extra, comment, offset = struct.unpack_from("<10xH4xIIIHHH8xI", data, at)
        name = data[at + 46 : at + 46 + names].decode("utf-8", "replace")
        packed, full, offset = _wide_values(data[at + 46 + names : at + 46 + names + extra], full, packed, offset)
        out.append(Entry(name, method, packed, full, crc, offset))
        at += 46 + names + extra + comment
    return out


def _wide_values(extra: bytes, full: int, packed: int, offset: int) -> tuple[int, int, int]:
    """Sizes and place from the 64-bit field where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            full, packed, offset = (next(values) if x == 0xFFFFFFFF else x for x in (full, packed, offset))
            break
        at += 4 + n
    return packed, full, offset


def zip_member(fetch: Callable[[int, int], bytes], entry: Entry) -> bytes:
    """One member by two ranged reads, checked against its checksum."""
    names, extra = struct.unpack("<26xHH", fetch(entry.offset, entry.offset + 30))
    start = entry.offset + 30 + names + extra
    raw = fetch(start, start + entry.packed)
    found = raw if entry.method == 0 else zlib.decompress(raw, -15) if entry.method == 8 else None
    if found is None or len(found) != entry.size or zlib.crc32(found) != entry.crc:
        raise ValueError(f"{entry.name} is packed in a way that is not known, or damaged")
    return found


def zip_members(files: DataFrame, wanted: str = ".*") -> DataFrame:
    """(path, name, size, content) of members whose names match, of files(path, content); others are not unpacked."""
    import re

    pattern = re.compile(wanted)

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                fetch = lambda a, b: bytes(content[a:b])  # noqa: B023, E731
                for e in zip_directory(fetch, len(content)):
                    if pattern.fullmatch(e.name) and not e.name.endswith("/"):
                        yield pd.DataFrame([(path, e.name, e.size, zip_member(fetch, e))], columns=["path", "name", "size", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, content binary")


def tar_members(files: DataFrame) -> DataFrame:
    """(path, name, size, content) of archives read as binary files; one task an archive, a row a member."""
    import tarfile

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame([(path, m.name, m.size, tar.extractfile(m).read())], columns=["path", "name", "size", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, content binary")


def npz_rows(files: DataFrame, array: str) -> DataFrame:
    """(path, row, value array<double>) of one array of NPZ files(path, content); one-dimensional arrays give single values."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x = np.asarray(z[array], np.float64)
                x = x.reshape(len(x), -1)
                for a in range(0, len(x), 10_000):
                    part = x[a : a + 10_000]
                    yield pd.DataFrame({"path": path, "row": np.arange(a, a + len(part)), "value": list(part)})

    return files.select("path", "content").mapInPandas(run, "path string, row long, value array<double>")
