"""Order-dependent clustering and fusion of ranked places, one query at a time.

Greedy steps within a query are sequential; queries are independent.  Candidates are dealt by
query, sorted, and streamed through Arrow batches: a task holds one query's list at a time, and
lists are top-k lists, bounded by their k.  A list is a ``Group``: a numpy array a column.

Nearly every greedy here is one step said again, ``peel``: of a square matrix of what is near what,
take out a founder with all that are near it and still there.  The rules differ in who founds next
(the first in an order, or the heaviest neighbourhood) and in what is told of each group.  All sort
by stated keys first, so results do not depend on arrival order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EARTH_KM = 6371.0


class Group(dict):
    """One query's rows: name to array.  ``group[order]`` reorders or cuts all columns."""

    @classmethod
    def of(cls, rows: list[dict]) -> Group:
        return cls({c: np.array([r[c] for r in rows]) for c in rows[0]} if rows else {})

    def __len__(self) -> int:
        return len(next(iter(self.values()))) if self.keys() else 0

    def __getitem__(self, what):
        return dict.__getitem__(self, what) if isinstance(what, str) else Group({c: v[what] for c, v in self.items()})

    def by(self, *keys) -> Group:
        """Sorted by arrays or column names, the first the strongest; stable."""
        return self[np.lexsort([self[k] if isinstance(k, str) else k for k in reversed(keys)])]


def km(a, b):
    """Great-circle distance of (lat, lon) pairs of numbers or arrays."""
    (p, l1), (q, l2) = (np.radians(np.asarray(x, float)) for x in (a, b))
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((l2 - l1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def km_exact(a: tuple[float, float], b: tuple[float, float]) -> float:
    """``km`` of two pairs by the C library, bit for bit as SQL engines have it: settles what is equal but for the last bit."""
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.pow(math.sin(math.radians(b[0] - a[0]) / 2), 2) + math.cos(p) * math.cos(q) * math.pow(math.sin(math.radians(b[1] - a[1]) / 2), 2)
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def km_between(a: Group, b: Group | None = None) -> np.ndarray:
    """Distances of all rows of one list to all of another (or itself)."""
    b = a if b is None else b
    return km((a["lat"][:, None], a["lon"][:, None]), (b["lat"][None, :], b["lon"][None, :]))


def sphere_mean(g: Group, weights: np.ndarray) -> tuple[float, float]:
    """The direction of the weighted sum of unit vectors; where they cancel, the first place."""
    lat, lon = np.radians(g["lat"]), np.radians(g["lon"])
    vectors = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    x, y, z = vectors @ weights
    if x * x + y * y + z * z <= 1e-24:
        return float(g["lat"][0]), float(g["lon"][0])
    return math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x))


def peel(near: np.ndarray, founder: Callable[[np.ndarray], int] = np.ndarray.argmax, most: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(founder, members) until nothing is left or ``most`` groups; ``founder`` chooses among the rows marked as left, by default the first."""
    left = np.ones(len(near), bool)
    while left.any() and most != 0:
        f = int(founder(left))
        members = near[f] & left
        members[f] = True
        left ^= members  # all of them were left
        most = None if most is None else most - 1
        yield f, members.nonzero()[0]


def heaviest(near: np.ndarray, weights: np.ndarray) -> Callable[[np.ndarray], int]:
    """The row whose near rows weigh most, of those left (to twelve places, then the first).

    Weights are added one after the other: rows near the same rows then weigh the same to the last
    bit, which a matrix product does not promise.
    """

    def choose(left: np.ndarray) -> int:
        mass = np.where(near & left, weights, 0.0).cumsum(axis=1)[:, -1]
        return int(np.where(left, mass.round(12), -np.inf).argmax())

    return choose


def first_fit(g: Group, radius_km: float, limit: int) -> list[tuple]:
    """(place, lat, lon, score, support, dispersion_km): ranked points join the first seed within the radius (<=), else found a cluster.

    The centre is the mean with weights exp((score - best) / 0.05).
    """
    g = g.by("rank", -g["score"])
    out = []
    for k, (_, members) in enumerate(peel(km_between(g) <= radius_km, most=limit), 1):
        if len(members) == 1:
            i = int(members[0])
            out.append((k, float(g["lat"][i]), float(g["lon"][i]), float(g["score"][i]), 1, 0.0))
            continue
        own = g[members]
        best = float(own["score"].max())
        centre = sphere_mean(own, np.maximum(np.exp(np.clip((own["score"] - best) / 0.05, -20, 0)), 1e-6))
        out.append((k, *centre, best, len(own), float(km((own["lat"], own["lon"]), centre).max())))
    return out


def round_robin(a: Group, b: Group, radius_km: float, limit: int) -> list[tuple]:
    """(position, source, place, lat, lon): alternate two ranked lists, passing over places within the radius of one taken; scores are never compared.

    What is taken closes all that is near it in both lists, so each side's next is its first open row.
    """
    sides = [x.by("place") for x in (a, b) if len(x)]
    names = [n for n, x in (("a", a), ("b", b)) if len(x)]
    open_rows = [np.ones(len(x), bool) for x in sides]
    out: list[tuple] = []
    while len(out) < limit and any(o.any() for o in open_rows):
        for name, side, mine in zip(names, sides, open_rows, strict=True):
            if mine.any() and len(out) < limit:
                i = int(mine.argmax())
                here = float(side["lat"][i]), float(side["lon"][i])
                for x, o in zip(sides, open_rows, strict=True):
                    o &= km((x["lat"], x["lon"]), here) > radius_km
                mine[i] = False
                out.append((len(out) + 1, name, int(side["place"][i]), *here))
    return out


def text_clusters(g: Group, radius_km: float = 25.0, top: int = 8) -> list[tuple]:
    """(place, lat, lon, weight, share, places, photos, users) of matches (is_place, user, id, lat, lon): a place weighs 1, a user's photos together 1; share is of the whole weight."""
    g = g.by(~g["is_place"], "id")
    photo = ~g["is_place"]
    users, of = np.unique(g["user"].astype(str), return_inverse=True)
    w = np.where(photo, 1.0 / np.maximum(np.bincount(of[photo], minlength=len(users)), 1)[of], 1.0)
    near = km_between(g) < radius_km
    out = []
    for k, (f, members) in enumerate(peel(near, heaviest(near, w), top), 1):
        mass, shot = float(w[members].sum()), photo[members]
        out.append((k, float(g["lat"][f]), float(g["lon"][f]), mass, mass / float(w.sum()), int((~shot).sum()), int(shot.sum()), len(np.unique(of[members][shot]))))
    return out


def softmax(scores: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((scores - scores.max()) / temperature)
    return e / e.sum()


def agreement_areas(g: Group, radius_km: float = 25.0, temperature: float = 0.2) -> list[tuple]:
    """(area, founder, best, members, support) to exhaustion: founder with the most softmax mass among what is left."""
    g = g.by("pos")
    w, near = softmax(g["score"], temperature), km_between(g) < radius_km
    groups = enumerate(peel(near, heaviest(near, w)), 1)
    return [(k, int(g["pos"][f]), int(g["pos"][m[g["score"][m].argmax()]]), len(m), float(w[m].sum())) for k, (f, m) in groups]


def mass_areas(g: Group, radius_km: float = 25.0, top: int = 3) -> list[tuple]:
    """(area, founder, mass) of weighted rows (pos, w)."""
    g = g.by("pos")
    near = km_between(g) < radius_km
    return [(k, int(g["pos"][f]), float(g["w"][m].sum())) for k, (f, m) in enumerate(peel(near, heaviest(near, g["w"]), top), 1)]


def merge_heaviest(g: Group, radius_km: float = 25.0) -> list[tuple]:
    """(place, id, weight, phrases): heaviest first, join the first kept place within the radius (<); the centre stays the founder's."""
    g = g.by(-g["weight"], "id")
    groups = enumerate(peel(km_between(g) < radius_km), 1)
    return [(k, int(g["id"][f]), float(g["weight"][m].sum()), ",".join(sorted({str(x) for x in g["phrase"][m]}))) for k, (f, m) in groups]


def agree_ranked(g: Group, radius_km: float = 25.0, temperature: float = 0.02) -> list[tuple]:
    """(area, founder_rank, share): first-fit in list order with weights exp((s - s0) / t); areas by mass, then by order of founding."""
    g = g.by("rank")
    w = np.exp((g["score"] - g["score"][0]) / temperature)
    groups = [(f, float(w[m].sum())) for f, m in peel(km_between(g) < radius_km)]
    total = sum(mass for _, mass in groups)
    return [(k, int(g["rank"][f]), mass / total) for k, (f, mass) in enumerate(sorted(groups, key=lambda x: -x[1]), 1)]


def merge_sources(g: Group, radius_km: float = 25.0) -> list[tuple]:
    """(id, candidate, centre_id): clusters of several sources by share / log2(2 + n); each joins the nearest centre within the radius (<), else starts one."""
    g = g.by(-(g["share"] / np.log2(2 + g["n"])), "id")
    far, ids = km_between(g), g["id"]
    spots = list(zip(g["lat"].tolist(), g["lon"].tolist(), strict=True))
    centres: list[int] = []
    out = []
    for i in range(len(g)):
        d = far[i, centres]
        k, least = (int(d.argmin()), float(d.min())) if centres else (-1, math.inf)
        if abs(least - radius_km) < 1e-6 or (d < least + 1e-6).sum() > 1:  # too near a tie for the last bits of an array's sines
            d = [km_exact(spots[c], spots[i]) if x < least + 1e-6 else math.inf for c, x in zip(centres, d.tolist(), strict=True)]
            least = min(d)
            k = d.index(least)
        if k < 0 or least >= radius_km:
            k = len(centres)
            centres.append(i)
        out.append((int(ids[i]), k + 1, int(ids[centres[k]])))
    return out


def spread_keep(g: Group, radius_km: float, most: int) -> list[tuple]:
    """(place, id): heaviest first, keep what is at least the radius from everything kept."""
    g = g.by(-g["weight"], "id")
    return [(k, int(g["id"][f])) for k, (f, _) in enumerate(peel(km_between(g) < radius_km, most=most), 1)]


def new_areas(g: Group, radius_km: float = 25.0, most: int = 2) -> list[tuple]:
    """(area, founder, mass) of weighted rows (pos, w, taken): the heaviest areas whose founders keep the radius from every taken place, and from each other.

    Areas are peeled from all rows; one founded within the radius (<) of a taken place, or of an
    area kept before, is no news.
    """
    g = g.by("pos")
    far, taken = km_between(g), g["taken"].astype(bool)
    near = far < radius_km
    kept: list[int] = []
    out = []
    for f, m in peel(near, heaviest(near, g["w"])):
        if len(out) < most and not near[f, taken].any() and not near[f, kept].any():
            kept.append(f)
            out.append((len(out) + 1, int(g["pos"][f]), float(g["w"][m].sum())))
    return out


def merge_named(g: Group, within_km: float = 0.5, street_km: float = 3.0) -> list[tuple]:
    """(id, name, address): same name and kind within a distance (streets: a longer one) are one; the first survives and takes the first address there is."""
    g = g.by("id")
    reach = np.where(g["kind"] == "street", street_km, within_km)
    alike = (g["name"][:, None] == g["name"][None, :]) & (g["kind"][:, None] == g["kind"][None, :]) & (km_between(g) < reach[None, :])
    return [(int(g["id"][f]), str(g["name"][f]), next((str(x) for x in g["address"][m] if x), g["address"][f])) for f, m in peel(alike)]


def apply(df: DataFrame, key: str, key_type: str, fn, fields: str, **how) -> DataFrame:
    """One of the functions above on each query's rows: dealt by key, sorted, streamed query by query."""
    spark_schema = StructType.fromDDL(f"{key} {key_type}, {fields}")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(spark_schema)
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out, strict=True))
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            out.clear()
            return made

        for k, g in groups(batches, key):
            out += [(k, *r) for r in fn(g, **how)]
            if len(out) >= 4096:
                yield batch()
        if out:
            yield batch()

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, spark_schema)


def groups(batches, key: str) -> Iterator[tuple]:
    """(key, Group) of rows sorted by key; a batch's last key may go on in the next."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = Group({c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(b.schema.names)})
        held = now if held is None else Group({c: np.concatenate([held[c], now[c]]) for c in now})
        keys = held[key]
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield _plain(keys[a]), held[a:z]
        held = held[cuts[-1] :]
    if held is not None:
        yield _plain(held[key][0]), held


def _plain(x):
    return x.item() if hasattr(x, "item") else x


def apply_two(a: DataFrame, b: DataFrame, key: str, key_type: str, fn, fields: str, **how) -> DataFrame:
    """The same for two lists a query, told apart by a marker column."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))

    def split(g: Group, **how):
        return fn(g[g["__side"] == 0], g[g["__side"] == 1], **how)

    return apply(both, key, key_type, split, fields, **how)
