"""Compare a query with its SQL twin, row by row."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def _cell(x):
    """Whole numbers stay as they are; other numbers become floats; the rest becomes text."""
    if isinstance(x, bool | int) or x is None:
        return x
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() and x.as_tuple().exponent >= 0 else float(x)
    return float(x) + 0.0 if isinstance(x, float) else str(x)


def _key(row: tuple) -> tuple:
    """Sorts rows alike on both sides: floats by six places, last."""
    return tuple(repr(x) for x in row if not isinstance(x, float)), tuple(round(x, 5) for x in row if isinstance(x, float))


def _same(x, y) -> bool:
    if type(x) is not type(y):
        return False
    return x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in found), key=_key)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when both agree."""
    df = query(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    want_columns = [c[0] for c in rel.description]
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} and {sorted(want_columns)}"
    got, want = rows(df.columns, got_rows), rows(want_columns, rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if not all(_same(x, y) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return "" if got else "no rows"
