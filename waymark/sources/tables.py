"""Filtered listings, counts and run logs over control tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def listing(df: DataFrame, filters: dict | None = None, order: list | None = None, limit: int | None = None) -> DataFrame:
    """Rows that equal all given filters (None: not asked), in order, at most limit."""
    conditions = [F.col(k) == v for k, v in (filters or {}).items() if v is not None]
    out = df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def counts_by(df: DataFrame, column: str, members: list[str]) -> DataFrame:
    """Count of each member of an enumeration, zero where there is none: one row for each, from one pass."""
    found = df.agg(*[F.count_if(F.col(column) == m).alias(m) for m in members])
    return found.select(F.explode(F.array(*[F.struct(F.lit(m).alias(column), F.col(m).alias("n")) for m in members])).alias("x")).select("x.*")


def newest(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def setting(df: DataFrame, key: str, default=None):
    """A setting decoded: null or blank gives the default, JSON its value, anything else the text. One row is read."""
    import json

    row = df.where(F.col("setting_key") == key).select("setting_value").limit(1).collect()
    text = row[0][0] if row else None
    if text is None or not text.strip():
        return default
    try:
        return json.loads(text)
    except ValueError:
        return text


def newest_files(spark, pattern: str, top: int = 10) -> DataFrame:
    """The newest files of a pattern (reports, manifests of exports): path, name, modified, length, newest first. Their bodies aren't read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")
    return files.orderBy(F.col("modified").desc(), F.col("path").desc()).limit(top)
