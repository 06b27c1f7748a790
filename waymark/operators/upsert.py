"""Keyed upserts without a lakehouse format: a full-outer merge with a rule for each column, and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERWRITE, COALESCE, APPEND, KEEP = "overwrite", "coalesce_new_old", "append_array", "keep_old"


def latest(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key, so that a merge gets each key once: that with the largest order, of these (or without an order) the last in df's own order."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*([F.col(order)] if order else []), F.col("__at"))
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("__r")).select(*keys, "__r.*") if rest else df.distinct()


def merge(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, str] | None = None, default: str = OVERWRITE, order: str | None = None) -> DataFrame:
    """target with source's rows inserted or merged by keys (null keys match each other).

    Rules by column: overwrite; coalesce_new_old (a null keeps the old value); append_array (distinct
    elements, old first); keep_old.
    """
    rules, columns = rules or {}, target.columns
    new = latest(source.select([c for c in columns if c in source.columns] + ([order] if order and order not in columns else [])), keys, order)
    old = target.select(*[F.col(c).alias(f"__o_{c}") for c in columns], F.lit(True).alias("__old"))
    new = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns if c in columns], F.lit(True).alias("__new"))
    on = [F.col(f"__o_{k}").eqNullSafe(F.col(f"__n_{k}")) for k in keys]
    both = old.join(new, on, "full_outer")
    has_old, has_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    out = []
    for c in columns:
        o = F.col(f"__o_{c}")
        n = F.col(f"__n_{c}") if f"__n_{c}" in new.columns else None
        rule = rules.get(c, default)
        if c in keys:
            value = F.when(has_old, o).otherwise(n)
        elif n is None:
            value = o
        elif rule == COALESCE:
            value = F.coalesce(n, o)
        elif rule == APPEND:
            value = F.when(o.isNull(), n).when(n.isNull(), o).otherwise(F.array_distinct(F.concat(o, n)))
        elif rule == KEEP:
            value = F.when(has_old, o).otherwise(n)
        else:
            value = F.when(has_new, n).otherwise(o)
        out.append(value.alias(c))
    return both.select(*out)


def replaced(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target without the rows whose keys occur in source, and with all of source: delete and reinsert."""
    on = [target[k].eqNullSafe(source[k]) for k in keys]
    return target.join(source.select(*keys).distinct(), on, "left_anti").unionByName(source)


class VersionedTable:
    """A table at path: each write is a new directory, and a pointer file names the current one.

    The pointer is itself a small Spark table, so that any file system that Spark reads will do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def current(self) -> str | None:
        try:
            rows = self.spark.read.text(f"{self.path}/_pointer").collect()  # one row for each version
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return max((r[0] for r in rows), default=None)

    def read(self) -> DataFrame | None:
        at = self.current()
        return None if at is None else self.spark.read.parquet(f"{self.path}/{at}")

    def write(self, df: DataFrame) -> None:
        at = self.current()
        version = f"v{int(at[1:9]) + 1 if at else 1:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{version}")
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("append").text(f"{self.path}/_pointer")

    def upsert(self, source: DataFrame, keys: list[str], rules: dict[str, str] | None = None, order: str | None = None) -> None:
        old = self.read()
        self.write(latest(source, keys, order).drop(*([order] if order and order.startswith("__") else [])) if old is None else merge(old, source, keys, rules, order=order))
