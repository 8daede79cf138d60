"""Map objects from the binary interchange format of OpenStreetMap extracts.

A file is a row of blobs, each a small header and a (zlib) message; messages are protocol buffers,
read here field by field.  Files are read as binary rows (path, content), one task a file, and
objects leave in batches.  Field numbers are fixed values of the published format.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "kind string, id long, lat double, lon double, refs array<long>, members array<struct<kind:string,id:long,role:string>>, tags map<string,string>"
KINDS = ("node", "way", "relation")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers, or bytes for all that has a length."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def numbers(data: bytes) -> np.ndarray:
    """A packed list of unsigned numbers, decoded all at once: a byte under 128 ends a number."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    starts = np.r_[0, np.flatnonzero(raw < 128)[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(x: np.ndarray) -> np.ndarray:
    """Zigzag numbers to signed ones."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _all(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for k, v in fields(data):
        out.setdefault(k, []).append(v)
    return out


def blobs(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(type, message) of a file's blobs."""
    at = 0
    while at + 4 <= len(content):
        n = int.from_bytes(content[at : at + 4], "big")
        head = _all(content[at + 4 : at + 4 + n])
        size = head[3][0]
        body = _all(content[at + 4 + n : at + 4 + n + size])
        if 1 not in body and 3 not in body:
            raise ValueError("a blob that is neither plain nor zlib")
        yield head[1][0].decode(), body[1][0] if 1 in body else zlib.decompress(body[3][0])
        at += 4 + n + size


def objects(content: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA: dense and plain nodes, ways and relations."""
    for kind, message in blobs(content):
        if kind != "OSMData":
            continue
        block = _all(message)
        words = [s.decode("utf-8", "replace") for k, s in fields(block[1][0]) if k == 1]
        grain, lat0, lon0 = (block.get(k, [default])[0] for k, default in ((17, 100), (19, 0), (20, 0)))
        degrees = lambda x, zero: (zero + grain * x) * 1e-9  # noqa: B023, E731
        for group in map(_all, block.get(2, [])):
            for raw in group.get(2, []):
                yield from _dense(_all(raw), words, lambda x: degrees(x, lat0), lambda x: degrees(x, lon0))
            for i, numbered in ((1, "node"), (3, "way"), (4, "relation")):
                for raw in group.get(i, []):
                    one = _all(raw)
                    packed = lambda k: numbers(b"".join(one.get(k, [])))  # noqa: B023, E731
                    tags = {words[a]: words[b] for a, b in zip(packed(2).tolist(), packed(3).tolist(), strict=True)}
                    if numbered == "node":
                        zig = lambda k: int(signed(np.array(one[k], np.uint64))[0])  # noqa: B023, E731
                        yield "node", zig(1), degrees(zig(8), lat0), degrees(zig(9), lon0), [], [], tags
                    elif numbered == "way":
                        yield "way", one[1][0], None, None, np.cumsum(signed(packed(8))).tolist(), [], tags
                    else:
                        ids = np.cumsum(signed(packed(9))).tolist()
                        members = [{"kind": KINDS[t], "id": i, "role": words[r]} for r, i, t in zip(packed(8).tolist(), ids, packed(10).tolist(), strict=True)]
                        yield "relation", one[1][0], None, None, [], members, tags


def _dense(one: dict, words: list[str], lat, lon) -> Iterator[tuple]:
    """Nodes in columns: ids and places as differences, tags as one list with a zero after each node."""
    columns = [np.cumsum(signed(numbers(b"".join(one.get(k, []))))) for k in (1, 8, 9)]
    said = numbers(b"".join(one.get(10, []))).tolist()
    at = 0
    for i, a, b in zip(*columns, strict=True):
        tags = {}
        while at < len(said) and said[at]:
            tags[words[said[at]]] = words[said[at + 1]]
            at += 2
        at += 1
        yield "node", int(i), float(lat(int(a))), float(lon(int(b))), [], [], tags


def map_objects(files: DataFrame, kinds: tuple[str, ...] = KINDS, key: str | None = None) -> DataFrame:
    """SCHEMA of files(path, content); only some kinds, and only objects that have the tag ``key``, leave the task."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for r in objects(bytes(content)):
                    if r[0] in kinds and (key is None or key in r[6]):
                        rows.append(r)
                        if len(rows) >= 20_000:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "id", "lat", "lon", "refs", "members", "tags"])


# -- writing, for extracts of one's own ------------------------------------------------------------


def _bytes(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _zig(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def _field(k: int, value: int | bytes) -> bytes:
    return _bytes(k << 3) + _bytes(value) if isinstance(value, int) else _bytes(k << 3 | 2) + _bytes(len(value)) + value


def _packed(k: int, values) -> bytes:
    return _field(k, b"".join(map(_bytes, values)))


def encode(nodes: list[tuple], ways: list[tuple] = (), relations: list[tuple] = ()) -> bytes:
    """A file of nodes (id, lat, lon, tags), ways (id, refs, tags) and relations (id, [(kind, id, role)], tags); nodes are written dense."""
    table: dict[str, int] = {"": 0}
    word = lambda s: table.setdefault(s, len(table))
    steps = lambda xs: [_zig(b - a) for a, b in zip([0, *xs], xs, strict=False)]
    said = [x for n in nodes for x in [*(word(y) for kv in n[3].items() for y in kv), 0]]
    grid = lambda x: round(x * 1e7)
    dense = _packed(1, steps([n[0] for n in nodes])) + _packed(8, steps([grid(n[1]) for n in nodes])) + _packed(9, steps([grid(n[2]) for n in nodes])) + _packed(10, said)
    tags = lambda t: _packed(2, [word(k) for k in t]) + _packed(3, [word(v) for v in t.values()])
    groups = [_field(2, _field(2, dense))] if nodes else []
    if ways:
        groups.append(_field(2, b"".join(_field(3, _field(1, i) + tags(t) + _packed(8, steps(list(refs)))) for i, refs, t in ways)))
    if relations:
        groups.append(_field(2, b"".join(_field(4, _field(1, i) + tags(t) + _packed(8, [word(r) for *_, r in m]) + _packed(9, steps([x for _, x, _ in m])) + _packed(10, [KINDS.index(k) for k, *_ in m])) for i, m, t in relations)))
    block = _field(1, b"".join(_field(1, s.encode()) for s in table)) + b"".join(groups)
    out = b""
    for kind, message in (("OSMHeader", _field(4, b"OsmSchema-V0.6")), ("OSMData", block)):
        body = _field(2, len(message)) + _field(3, zlib.compress(message))
        head = _field(1, kind.encode()) + _field(3, len(body))
        out += len(head).to_bytes(4, "big") + head + body
    return out
