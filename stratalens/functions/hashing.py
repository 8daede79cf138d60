"""Deterministic buckets, splits and samples from digests of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.sources.shared import written


def _hex(text: Column, start: int, n: int = 8) -> Column:
    return F.conv(F.substring(text, start, n), 16, 10).cast("long")


def _text(key) -> Column:
    return (key if isinstance(key, Column) else F.col(key)).cast("string")


def md5_bucket(key, buckets: int = 100) -> Column:
    """The whole 128-bit md5 modulo ``buckets``, folded over four 32-bit chunks."""
    digest, step = F.md5(_text(key)), (1 << 32) % buckets
    acc: Column = F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        acc = F.pmod(acc * step + _hex(digest, start), F.lit(buckets))
    return acc.cast("int")


def md5_fold(key, folds: int) -> Column:
    """The first 32 bits of md5 modulo ``folds``."""
    return (_hex(F.md5(_text(key)), 1) % folds).cast("int")


def sha_parity(prefix: str, key) -> Column:
    """0 or 1 from the first 32 bits of sha256(prefix:key)."""
    return (_hex(F.sha2(F.concat(F.lit(prefix + ":"), _text(key)), 256), 1) % 2).cast("int")


def sha_share(prefix: str, key) -> Column:
    """A number in [0, 1) from the first 32 bits of sha256(prefix:key)."""
    return _hex(F.sha2(F.concat(F.lit(prefix + ":"), _text(key)), 256), 1) / F.lit(4294967296.0)


def opaque(prefix: str, key, length: int = 12) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(prefix + ":"), _text(key)), 256), 1, length)


def order(salt: str, key) -> Column:
    """A stable random order of keys."""
    return F.sha2(F.concat(F.lit(salt + ":"), _text(key)), 256)


def bit_distance(a, b) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def covering_masks(radius: int, bits: int) -> list[int]:
    """Masks of a hash's bits such that any ``radius`` bits are all masked out by one of them.

    Each bit has a vector of radius + 1 bits and mask t keeps the bits whose vectors have an odd
    product with t: radius vectors never span the whole space, so some t is even with all of them.
    Of the strides that deal vectors to bits, the one whose shortest mask is longest is taken.
    """
    size = (1 << (radius + 1)) - 1

    def masks(stride: int) -> list[int]:
        vectors = [1 + i * stride % size for i in range(bits)]
        return [sum(1 << i for i, v in enumerate(vectors) if (v & t).bit_count() % 2) for t in range(1, size + 1)]

    return max((masks(s) for s in range(1, size)), key=lambda m: min(x.bit_count() for x in m))


def within_bits(hashes, key: str, value: str, radius: int, bits: int):
    """(a, b, bits) of pairs a < b of hashes (key, value: a long) that differ in ``radius`` bits at most.

    Hashes meet by an equi-join on each mask's bits; a pair that meets under several masks counts
    under the first.  Equal hashes are joined as one value, so copies do not multiply the meetings.
    """
    # Written once: a runtime filter of Spark's carries the expression of a hash to where its columns are not.
    hashes = written(hashes.select(key, value), "hashes")
    masks = covering_masks(radius, bits)
    literal = F.array(*[F.lit(m) for m in masks])
    distinct = hashes.select(F.col(value).alias("h")).distinct()
    keyed = distinct.select("h", F.posexplode(F.transform(literal, lambda m: F.col("h").bitwiseAND(m))).alias("t", "k"))
    x, y = keyed.withColumnRenamed("h", "hx"), keyed.withColumnRenamed("h", "hy")
    differ = F.col("hx").bitwiseXOR(F.col("hy"))
    first = F.array_position(F.transform(literal, lambda m: differ.bitwiseAND(m)), F.lit(0).cast("long")) - 1
    # The planner counts neither the masks nor the pairs, so it may take a side for small: none must be broadcast.
    met = x.hint("merge").join(y, ["t", "k"]).where((F.col("hx") <= F.col("hy")) & (F.bit_count(differ) <= radius)).where(first == F.col("t"))
    near = met.select("hx", "hy", F.bit_count(differ).cast("int").alias("bits"))
    way = lambda x, y: F.struct(F.col(x).alias("hx"), F.col(y).alias("hy"), "bits")
    near = near.select(F.inline(F.when(F.col("hx") < F.col("hy"), F.array(way("hx", "hy"), way("hy", "hx"))).otherwise(F.array(way("hx", "hy")))))
    a = hashes.select(F.col(key).alias("a"), F.col(value).alias("hx"))
    b = hashes.select(F.col(key).alias("b"), F.col(value).alias("hy"))
    return a.hint("merge").join(near, "hx").join(b.hint("merge"), "hy").where("a < b").select("a", "b", "bits")


def perceptual(grey):
    """64-bit perceptual hash of a 32 x 32 grey image: low 8 x 8 cosine coefficients against their median."""
    import numpy as np

    n = 32
    k, x = np.arange(8)[:, None], np.arange(n)[None]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    low = (basis @ np.asarray(grey, float).reshape(n, n) @ basis.T).ravel()
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">u8")[0])
