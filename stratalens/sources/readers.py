"""Readers with fixed schemas, and parsers of dump formats."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import geo
from stratalens.sources.shared import written


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, id) of a file ``row<TAB>id``; names that could leave a folder are refused."""
    lines = spark.read.schema("row long, id string").csv(path, sep="\t", quote="")
    return lines.where(F.col("id").rlike(r"^[A-Za-z0-9_.-]+$") & ~F.col("id").contains(".."))


def resolve_paths(ids: DataFrame, files: DataFrame, id_col: str = "id") -> DataFrame:
    """ids joined to files(path) on the stem; the least path wins."""
    stems = files.select(F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1).alias(id_col), "path")
    return ids.join(stems.groupBy(id_col).agg(F.min("path").alias("path")), id_col, "left")


def points_csv(spark: SparkSession, path: str, schema: str, lat: str, lon: str) -> DataFrame:
    """A CSV with a header and declared types; rows without a valid place are dropped, and ``NA`` stays a string."""
    df = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", nullValue="\u0000")
    return df.where(geo.valid(lat, lon))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, alias, lat, lon, cc, population) of a 19-column tab-separated gazetteer, one row a name or alias."""
    names = ["id", "name", "ascii", "aliases", "lat", "lon", "class", "code", "cc", "cc2", "a1", "a2", "a3", "a4", "population", "elevation", "dem", "zone", "modified"]
    kinds = {"id": "long", "lat": "double", "lon": "double", "population": "long"}
    df = spark.read.schema(", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)).csv(path, sep="\t", quote="")
    every = F.array_distinct(F.filter(F.concat(F.array("name"), F.split(F.coalesce("aliases", F.lit("")), ",")), lambda x: x != ""))
    return df.select("id", "name", F.explode(every).alias("alias"), "lat", "lon", "cc", "population")


def country_codes(spark: SparkSession, path: str) -> DataFrame:
    """(phone, cc) from a table with ``#`` comments and several codes a row; the first row of a code wins."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("at", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    codes = F.filter(F.transform(F.split(F.element_at(f, 2), " and |,"), lambda x: F.regexp_replace(x, r"\D", "")), lambda x: x != "")
    return lines.select(F.element_at(f, 1).alias("cc"), F.explode(codes).alias("phone"), "at").groupBy("phone").agg(F.min_by("cc", "at").alias("cc"))


def table_by_ranges(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A database table read in primary-key ranges, one query a partition."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def by_key_ranges(spark: SparkSession, path: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table in files read in primary-key ranges of equal width, with the number of the range as ``part``.

    As a database read does it: each range is a scan of its own with the bounds pushed down (files
    written in key order are skipped by their statistics), the first and last are open, and rows
    without a key belong to the first.
    """
    step = max(1, -(-(high - low + 1) // parts))
    out = None
    for k in range(parts):
        at = F.col(key)
        lower, upper = at >= low + k * step, at < low + (k + 1) * step
        where = F.lit(True) if parts == 1 else (upper | at.isNull()) if not k else lower if k == parts - 1 else lower & upper
        one = spark.read.parquet(path).where(where).withColumn("part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


_ROW = re.compile(r"\(((?:[^()']|'(?:[^'\\]|\\.|'')*')*)\)")
_FIELD = re.compile(r"'((?:[^'\\]|\\.|'')*)'|([^,']+)")
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a"}


def sql_rows(line: str | None) -> list[list[str | None]]:
    """The tuples of one dump line (an INSERT with all its rows, or a row a line): strings, NULL as None, escapes undone."""
    if not line:
        return []
    body = line[line.upper().find("VALUES") + 6 :] if line.upper().startswith("INSERT") else line
    if not body.lstrip().startswith("("):
        return []
    out = []
    for m in _ROW.finditer(body):
        fields = []
        for text, bare in _FIELD.findall(m[1]):
            bare = bare.strip()
            fields.append((None if bare.upper() == "NULL" else bare) if bare else re.sub(r"\\(.)|''", lambda e: _ESCAPE.get(e[1], e[1]) if e[1] else "'", text))
        out.append(fields)
    return out


def sql_dump(lines: DataFrame, column: str = "value") -> DataFrame:
    """(fields array<string>) of the rows of a dump read as text lines."""
    parse = F.pandas_udf(lambda s: s.map(sql_rows), "array<array<string>>")
    return lines.select(F.explode(parse(F.col(column))).alias("fields"))


def xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of main-namespace pages of a wiki dump that are no redirects."""
    schema = "id long, ns int, title string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    df = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return df.where("ns = 0 and redirect is null").select("id", "title", F.col("revision.text._VALUE").alias("text"))


def search_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of a bulk file in which index lines and document lines alternate."""
    lines = spark.read.text(path).where(~F.col("value").startswith('{"index"'))
    return lines.select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*")


def matrix_rows(path: str, spark: SparkSession, columns: int) -> DataFrame:
    """A flat little-endian float32 file as rows (row, embedding): the file is read in records of one row."""
    rdd = spark.sparkContext.binaryRecords(path, 4 * columns).zipWithIndex()
    raw = rdd.toDF("raw binary, row long")

    def run(batches):
        import numpy as np

        for pdf in batches:
            m = np.frombuffer(b"".join(pdf["raw"]), "<f4").reshape(-1, columns)
            yield pd.DataFrame({"row": pdf["row"], "embedding": list(m)})

    return raw.mapInPandas(run, "row long, embedding array<float>")


def check_manifest(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Fail-fast contract of an embedding table: row keys dense from 0, every vector of one length."""
    found = df.agg(F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"), F.count_distinct("row").alias("d"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if (found.n, found.lo, found.hi, found.d, found.a, found.b) != (rows, 0, rows - 1, rows, columns, columns):
        raise ValueError(f"the table does not fit its manifest: {found.asDict()}")
    return df


def violations(df: DataFrame, rules: dict) -> DataFrame:
    """Counts of rows that break each named rule (a condition that must hold)."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def cached_search(asked: DataFrame, cache_path: str, answer, key: str = "key") -> DataFrame:
    """asked(key, ..) with ``answer`` (JSON) and ``src``: 'cache' where the key was answered before, else 'index'.

    ``answer(missing) -> (key, answer)`` asks the local index for all missing keys at once; its
    answers, also the empty ones, are stored, so that the next call finds them.
    """
    spark = asked.sparkSession
    try:
        stored = spark.read.schema("key string, answer string").parquet(cache_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], "key string, answer string")
    known = asked.join(stored, key).withColumn("src", F.lit("cache"))
    missing = asked.join(stored.select(key), key, "left_anti")
    fresh_answers = missing.join(answer(missing), key, "left").withColumn("answer", F.coalesce("answer", F.lit("[]"))).withColumn("src", F.lit("index"))
    out = written(known.unionByName(fresh_answers), "answers")
    out.where("src = 'index'").select(key, "answer").dropDuplicates([key]).write.mode("append").parquet(cache_path)
    return out


def paged_scan(rows: DataFrame, window: Column, order: list[str], cap: int) -> DataFrame:
    """What a service with ``cap`` rows an answer gives of each window when it is asked twice, first rows first and last rows first, each row once; ``complete`` says whether a window was had whole."""
    up, down = [F.col(c) for c in order], [F.col(c).desc() for c in order]
    numbered = rows.withColumn("__w", window).withColumn("__up", F.row_number().over(W.partitionBy("__w").orderBy(*up))).withColumn("__down", F.row_number().over(W.partitionBy("__w").orderBy(*down)))
    got = numbered.where((F.col("__up") <= cap) | (F.col("__down") <= cap))
    return got.withColumn("complete", F.col("__up") + F.col("__down") - 1 <= 2 * cap).drop("__w", "__up", "__down")
