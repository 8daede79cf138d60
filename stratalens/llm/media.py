"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

* mu-law and A-law bytes are expanded by 256-entry tables made from the G.711 rules.
* IMA ADPCM blocks (a 4-byte head with predictor and step index, then 4-bit codes, low nibble
  first) are decoded with numpy across blocks: one step of the recurrence runs over all blocks
  of a batch of recordings at once.
* PCM at 8 kHz is resampled to 16 kHz by a half-band filter and stored as a WAVE file.

``payload_columns`` stores any byte payload losslessly as the 8-bit samples of a mu-law WAVE
file, reads the samples back from the stored file, and derives features from what it read.

Defined cases: null text is empty text, whose payload is one block of 64 zero bytes; null or
repeated doc_id rows are stored each; other columns are ignored; an empty table gives an empty
result; a recording whose last ADPCM block is short is decoded as far as it goes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import arrow_batch, parts, table

UNIT, RATE = 64, 8000
PCM, ALAW, ULAW, IMA = 1, 6, 7, 17  # WAVE format tags (fixed values)
#: IMA step index moves by code (fixed values of the format).
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Half-band low-pass taps at odd distances 1, 3, 5, 7 from the centre (the centre is 1/2, even distances are 0).
_TAPS = np.array([0.3138, -0.0893, 0.0354, -0.0099])


def ulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted sign, 3-bit segment and 4-bit step; bias 132."""
    code = ~np.arange(256) & 0xFF
    size = ((code & 15) * 8 + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; a set sign bit is positive."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, code & 15
    size = np.where(segment == 0, step * 16 + 8, step * 16 + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def step_table() -> np.ndarray:
    """The 89 IMA quantiser steps (fixed values of the format)."""
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


_ULAW, _ALAW, _STEPS = ulaw_table(), alaw_table(), step_table()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """(n, size) bytes to (n, 2 * size - 7) samples; the head's predictor is the first sample."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes):
        step = _STEPS[index]
        gain = (code & 7).astype(np.int32)
        change = (step >> 3) + np.where(gain & 4, step, 0) + np.where(gain & 2, step >> 1, 0) + np.where(gain & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + _MOVES[gain], 0, 88)
        out[k + 1] = value
    return out.T


def adpcm(recordings: list[bytes], block: int = UNIT) -> list[np.ndarray]:
    """All recordings' whole blocks are decoded together; a short last block alone."""
    whole = [len(r) // block for r in recordings]
    joined = np.frombuffer(b"".join(r[: n * block] for r, n in zip(recordings, whole, strict=True)), np.uint8).reshape(-1, block)
    pcm, out, at = adpcm_blocks(joined), [], 0
    for r, n in zip(recordings, whole, strict=True):
        rest = r[n * block :]
        tail = adpcm_blocks(np.frombuffer(rest, np.uint8)[None])[0] if len(rest) >= 4 else np.zeros(0, np.int16)
        out.append(np.concatenate([pcm[at : at + n].ravel(), tail]))
        at += n
    return out


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: every sample stays, and between two comes the filtered mean of the neighbours (edges repeat)."""
    if not len(pcm):
        return pcm
    n, reach = len(pcm), len(_TAPS)
    wide = np.pad(pcm.astype(np.float64), (reach - 1, reach), mode="edge")
    taps = 2 * _TAPS / (4 * _TAPS.sum())
    between = sum(t * (wide[reach - 1 - k : reach - 1 - k + n] + wide[reach + k : reach + k + n]) for k, t in enumerate(taps))
    out = np.empty(2 * n, np.int16)
    out[0::2], out[1::2] = pcm, np.clip(np.rint(between), -32768, 32767)
    return out


def wave(samples: bytes, tag: int, rate: int, width: int) -> bytes:
    """A mono RIFF/WAVE file; formats other than PCM have an extension size of zero and a fact chunk."""
    head = struct.pack("<HHIIHH", tag, 1, rate, rate * width, width, 8 * width)
    if tag != PCM:
        head += b"\0\0"
    chunks = b"fmt " + struct.pack("<I", len(head)) + head
    if tag != PCM:
        chunks += b"fact" + struct.pack("<II", 4, len(samples) // width)
    chunks += b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wave(stored: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, sample bytes) of a stored file, found by walking its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data" and tag is not None:
            return tag, rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without samples")


def expand(recordings: list[bytes], tag: int) -> list[np.ndarray]:
    """Samples of one format to 16-bit PCM."""
    if tag == IMA:
        return adpcm(recordings)
    if tag == PCM:
        return [np.frombuffer(r[: len(r) // 2 * 2], "<i2") for r in recordings]
    lookup = {ULAW: _ULAW, ALAW: _ALAW}[tag]
    return [lookup[np.frombuffer(r, np.uint8)] for r in recordings]


def _shape(pcm: np.ndarray) -> str:
    """Root mean square (whole), peak and sign changes, in exact integer arithmetic where it matters."""
    x = pcm.astype(np.int64)
    rms = int(np.sqrt((x * x).sum() // max(1, len(x))))
    return f"{rms}:{int(np.abs(x).max(initial=0))}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def decode_media(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, pcm): stored mu-law, A-law, ADPCM or PCM files to 16 kHz PCM files; null or unreadable media give null."""
    id_type = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                out: list[bytes | None] = [None] * piece.num_rows
                by_tag: dict[int, list[tuple[int, bytes]]] = {}
                for i, stored in enumerate(piece.column(1).to_pylist()):
                    try:
                        tag, _, samples = read_wave(stored or b"")
                    except (ValueError, struct.error):
                        continue
                    if tag in (PCM, ALAW, ULAW, IMA):
                        by_tag.setdefault(tag, []).append((i, samples))
                for tag, found in by_tag.items():
                    for (i, _), pcm in zip(found, expand([s for _, s in found], tag), strict=True):
                        out[i] = wave(resample_double(pcm).astype("<i2").tobytes(), PCM, 2 * RATE, 2)
                yield arrow_batch(pa.schema([piece.schema.field(0), ("pcm", pa.binary())]), [piece.column(0), out])

    return media.select(id_col, media_col).mapInArrow(run, f"{id_col} {id_type}, pcm binary")


def payload_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_files: bool = False) -> DataFrame:
    """Store each whole text as mu-law samples, read it back, and describe what was read; ``with_files`` adds media and pcm."""
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("pcm_bytes", "long", pa.int64()), ("pcm_sha256", "string", pa.string())]
    fields += [("media", "binary", pa.binary()), ("pcm", "binary", pa.binary())] if with_files else []

    def run(batches):
        for batch, texts in parts(batches, "text", 64, 1 << 20):
            raw = [t.encode() for t in texts]
            stored = [wave(b + bytes(max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b)), ULAW, RATE, 1) for b in raw]
            back = [read_wave(s)[2] for s in stored]
            heard, other, blocks = expand(back, ULAW), expand(back, ALAW), expand(back, IMA)
            out = {k: [] for k, _, _ in fields}
            for b, s, p, u, a, d in zip(raw, stored, back, heard, other, blocks, strict=True):
                pcm = wave(resample_double(u).astype("<i2").tobytes(), PCM, 2 * RATE, 2)
                row = [len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), f"u{_shape(u)}|a{_shape(a)}|d{_shape(d)}", len(pcm), hashlib.sha256(pcm).hexdigest()]
                for k, v in zip(out, [*row, s, pcm], strict=False):
                    out[k].append(v)
            yield arrow_batch(pa.schema([batch.schema.field(0), *[(k, t) for k, _, t in fields]]), [batch.column(0), *out.values()])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, ", ".join([f"doc_id {id_type}", *[f"{k} {t}" for k, t, _ in fields]]))


def op3_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the stored files themselves: the mu-law file and the resampled PCM file of every document."""
    return payload_columns(table(spark, sf_dir, "documents"), with_files=True)
