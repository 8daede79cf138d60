"""How queries register, and what their SQL twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import geo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column, alias: str, places: int = 6):
    return F.round(column, places).alias(alias)


# -- derived points ------------------------------------------------------------------------------


def lat_sql(key: str) -> str:
    return f"(CAST((CAST({key} AS BIGINT) * 7919) % 17001 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE))"


def lon_sql(key: str) -> str:
    return f"(CAST((CAST({key} AS BIGINT) * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE))"


def hav_sql(a: str, b: str, c: str, d: str, radius: float = geo.EARTH_KM) -> str:
    return f"(2 * CAST({radius} AS DOUBLE) * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def points(spark: SparkSession, d: str, table: str, key: str, prefix: str = "", *more: str) -> DataFrame:
    """(key, [prefix]lat, [prefix]lon, more..) of a table with derived coordinates."""
    return t(spark, d, table).select(key, geo.derived_lat(key).alias(f"{prefix}lat"), geo.derived_lon(key).alias(f"{prefix}lon"), *more)


def points_sql(table: str, key: str, prefix: str = "", more: str = "") -> str:
    return f"(SELECT {key}, {lat_sql(key)} AS {prefix}lat, {lon_sql(key)} AS {prefix}lon{', ' + more if more else ''} FROM {table})"


#: Candidate pools: an order is a query, its lines are ranked candidates with a score and a place.
#: Scores are prices by an odd number: they and their differences are never a tie at the last decimal shown, where engines round apart.
#: Places scatter by fractions of a degree around one of three centres of the order, so that areas form.
POOL_SQL = f"""(SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS pos,
  l_extendedprice / CAST(131071 AS DOUBLE) AS score,
  CAST({lat_sql("l_orderkey")} * CAST(0.8 AS DOUBLE) + CAST(l_partkey % 3 AS DOUBLE) * CAST(2 AS DOUBLE) + CAST(l_suppkey % 7 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS DOUBLE) AS lat,
  CAST({lon_sql("l_orderkey")} * CAST(0.9 AS DOUBLE) + CAST(l_partkey % 5 AS DOUBLE) * CAST(0.04 AS DOUBLE) AS DOUBLE) AS lon,
  l_suppkey AS author FROM lineitem)"""


def pool(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    by = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    k = F.col("l_orderkey")
    return t(spark, d, "lineitem").select(
        k.alias("qid"),
        F.row_number().over(by).cast("long").alias("pos"),
        (F.col("l_extendedprice") / 131071.0).alias("score"),
        (geo.derived_lat(k) * 0.8 + (F.col("l_partkey") % 3).cast("double") * 2.0 + (F.col("l_suppkey") % 7).cast("double") * 0.05).alias("lat"),
        (geo.derived_lon(k) * 0.9 + (F.col("l_partkey") % 5).cast("double") * 0.04).alias("lon"),
        F.col("l_suppkey").alias("author"),
    )


#: The truth of an order's pool: near the first of its centres.
def truth_lat(k="qid"):
    return geo.derived_lat(F.col(k)) * 0.8 + 0.1


def truth_lon(k="qid"):
    return geo.derived_lon(F.col(k)) * 0.9 + 0.05


TRUTH_LAT = f"({lat_sql('qid')} * CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))"
TRUTH_LON = f"({lon_sql('qid')} * CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE))"
