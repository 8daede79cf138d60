"""Array<float> vectors as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.transform(v, lambda x: F.nanvl(x.cast("double"), F.lit(0.0)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def unit(v, floor: float = 1e-12) -> Column:
    """L2 normalisation; NaN and infinite entries count as 0, a zero vector stays zero."""
    clean = F.transform(v, lambda x: F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))), 0.0).otherwise(x.cast("double")))
    return _with(clean, norm(clean), lambda x, n: x / F.greatest(F.lit(floor), n))


def _with(v: Column, number: Column, fn) -> Column:
    """fn(element, number) over an array, with the number worked out once a row, not once an element."""
    bound = F.transform(F.array(F.struct(v.alias("v"), number.alias("n"))), lambda s: F.transform(s.v, lambda x: fn(x, s.n)))
    return F.get(bound, F.lit(0))


def quantise(v) -> tuple[Column, Column]:
    """(array<tinyint>, scale): symmetric, scale = max |x| / 127 of the unit vector, round half to even."""
    u = unit(v)
    scale = F.array_max(F.transform(u, F.abs)) / 127
    code = lambda x, s: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x / F.greatest(s, F.lit(1e-30)), 0).cast("int"))).cast("tinyint")
    return _with(u, scale, code), scale


def dequantise(q, scale) -> Column:
    return unit(F.transform(q, lambda x: x.cast("double") * scale))
