"""Selections with interacting limits.

A limit that is met stays met, so a row that is refused once is refused for good: a selection is a
walk through rows in hash order in which every row taken closes others.  ``Walk`` does that over
bounded batches: the table is asked, with what is closed already in the filter, for the first open
rows of each scope, so that no task and not the driver holds more than ``batch`` rows a scope,
however many candidates there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import geo, hashing
from stratalens.operators.clustering import Group, km

BATCH = 2000


@dataclass(frozen=True)
class Rules:
    """``caps``: column to how many rows of one value may be taken; ``gap_km``: least distance of rows taken."""

    caps: dict[str, int]
    gap_km: float = 0.0


class Walk:
    """Open candidates of df(id, .., [lat, lon]) in hash order, scope by scope (a column's values, or all rows as one)."""

    def __init__(self, df: DataFrame, rules: Rules, salt: str, scope: str | None = None, batch: int = BATCH):
        names = ["id", *rules.caps, *(["lat", "lon"] if rules.gap_km else [])]
        self.rules, self.batch = rules, batch
        where = F.lit("") if scope is None else F.coalesce(F.col(scope).cast("string"), F.lit(""))
        self.df = df.select(*dict.fromkeys(names), where.alias("scope"), hashing.order(salt, "id").alias("at"))
        self.taken: list[dict] = []
        self.counts: dict[tuple, int] = {}
        self.held: dict[str, Group] = {}
        self.open: dict[str, np.ndarray] = {}
        self.last: dict[str, str | None] = {}

    def _closed(self) -> Column:
        """What the rows taken so far have closed, as a filter of the table."""
        out = F.col("id").isin([r["id"] for r in self.taken]) if self.taken else F.lit(False)
        for c, cap in self.rules.caps.items():
            full = [v for (name, v), n in self.counts.items() if name == c and n >= cap]
            if full:
                out = out | F.coalesce(F.col(c).isin(full), F.lit(False))
        if self.rules.gap_km:
            for r in self.taken:
                out = out | (geo.haversine("lat", "lon", F.lit(r["lat"]), F.lit(r["lon"])) < self.rules.gap_km)
        return out

    def _fill(self, scopes: list[str] | None) -> None:
        """The next batch of open rows of each scope (all scopes when None), after the last one seen."""
        rows = self.df if scopes is None else self.df.where(F.col("scope").isin(scopes))
        for s in scopes or []:
            if self.last.get(s) is not None:
                rows = rows.where((F.col("scope") != s) | (F.col("at") > self.last[s]))
        by = W.partitionBy("scope").orderBy("at", "id")
        found = rows.where(~self._closed()).withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= self.batch).drop("rn")
        got: dict[str, list[dict]] = {}
        for r in found.orderBy("scope", "at", "id").toLocalIterator():
            got.setdefault(r["scope"], []).append(r.asDict())
        for s in scopes if scopes is not None else sorted(got):
            rows = got.get(s, [])
            self.held[s], self.open[s] = Group.of(rows), np.ones(len(rows), bool)
            self.last[s] = rows[-1]["at"] if len(rows) == self.batch else None

    def scopes(self) -> list[str]:
        if not self.held:
            self._fill(None)
        return sorted(self.held)

    def take(self, scope: str) -> dict | None:
        """The scope's first open row, taken with all that it closes; None when the scope has none."""
        while not self.open[scope].any():
            if self.last[scope] is None:
                return None
            self._fill([scope])
        i = int(self.open[scope].argmax())
        row = {c: v[i].item() if hasattr(v[i], "item") else v[i] for c, v in self.held[scope].items()}
        self.taken.append(row)
        for c in self.rules.caps:
            if row[c] is not None:  # what is not known is not capped
                self.counts[c, row[c]] = self.counts.get((c, row[c]), 0) + 1
        for s, g in self.held.items():
            if len(g):
                self.open[s] &= self._stays(g, row)
        return row

    def _stays(self, g: Group, row: dict) -> np.ndarray:
        ok = g["id"] != row["id"]
        for c, cap in self.rules.caps.items():
            if self.counts.get((c, row[c]), 0) >= cap:
                ok &= g[c] != row[c]
        if self.rules.gap_km:
            ok &= km((g["lat"], g["lon"]), (row["lat"], row["lon"])) >= self.rules.gap_km
        return ok


def hash_cohort(df: DataFrame, size: int, country_cap: int, first_per_region: int = 2, salt: str = "cohort", batch: int = BATCH) -> DataFrame:
    """(position, id) of df(id, region, country, sequence): in turn some of every region, then anyone, in hash order; a sequence once, a country at most ``country_cap`` times."""
    rules = Rules({"sequence": 1, "country": country_cap})
    regional = Walk(df, rules, salt, "region", batch)
    for _ in range(first_per_region):
        for region in regional.scopes():
            regional.take(region)
    anyone = Walk(df, rules, salt, None, batch)
    anyone.taken, anyone.counts = regional.taken, regional.counts
    while len(anyone.taken) < size and anyone.scopes() and anyone.take("") is not None:
        pass
    return _numbered(df, [(r["id"],) for r in anyone.taken[:size]], "id")


def balanced_pick(df: DataFrame, target: int, per_uploader: int, per_country: int, per_continent: int, gap_km: float, salt: str = "pick", batch: int = BATCH) -> DataFrame:
    """(position, id, continent) of df(id, lat, lon, continent, country, uploader): continents in turn, each giving its next row that breaks no cap and keeps the gap to all picked."""
    walk = Walk(df, Rules({"uploader": per_uploader, "country": per_country, "continent": per_continent}, gap_km), salt, "continent", batch)
    open_scopes = walk.scopes()
    while len(walk.taken) < target and open_scopes:
        open_scopes = [s for s in open_scopes if len(walk.taken) >= target or walk.take(s) is not None]
    return _numbered(df, [(r["id"], r["continent"]) for r in walk.taken], "id", "continent")


def _numbered(df: DataFrame, rows: list[tuple], *names: str) -> DataFrame:
    schema = ", ".join(["position int", *(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)])
    return df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], schema)


def cap_per_key(df: DataFrame, key: str | list[str], most: int, salt: str, row_id: str) -> DataFrame:
    """At most ``most`` rows a key, in hash order."""
    by = W.partitionBy(key).orderBy(hashing.order(salt, row_id), row_id)
    return df.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most)


def round_robin_depth(groups: DataFrame, limit: int) -> DataFrame:
    """groups(grp, depth, item): items by (depth, group), a repeated item at its first place only, first ``limit``."""
    by = W.partitionBy("item").orderBy("depth", "grp")
    firsts = groups.withColumn("__f", F.row_number().over(by)).where("__f = 1").drop("__f")
    return firsts.orderBy("depth", "grp").limit(limit)


def evenly(array, most: int = 32):
    """At most ``most`` entries of an array, evenly spaced, first and last kept."""
    n = F.size(array)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(array, (F.floor(i * (n - 1) / (most - 1)) + 1).cast("int")))
    return F.when(n <= most, array).otherwise(picks)
