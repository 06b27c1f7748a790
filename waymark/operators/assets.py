"""Canonical buildings and units from accepted results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.upsert import APPEND, merge

MIN_CONFIDENCE = 0.85


def promotable(results: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """results (of validate) to promote, with building_key and unit_key; a reference's key goes before the address's."""
    by_reference = F.sha2(F.concat(F.lit("REF|"), F.coalesce("country_code", F.lit("CA")), F.lit("|"), F.col("reference_external_id")), 256)
    ok = (F.col("decision") == "accept") & (F.col("confidence") >= min_confidence) & F.col("canonical_base_key").isNotNull()
    out = results.where(ok).withColumn("building_key", F.coalesce(by_reference, "canonical_base_key"))
    return out.withColumn("unit_key", F.when(F.col("suggested_unit").isNotNull(), F.sha2(F.concat("building_key", F.lit("|"), "suggested_unit"), 256)))


def _entities(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One row for each key: the attributes of the least raw_id, and all raw_ids in order."""
    picked = rows.groupBy("workspace_name", key).agg(
        F.min_by(F.struct(*attributes), "raw_id").alias("__a"), F.sort_array(F.collect_set(F.col("raw_id"))).alias("__ids"), F.count(F.lit(1)).alias("n_sources")
    )
    return picked.select("workspace_name", key, "__a.*", F.transform("__ids", lambda x: x.cast("string")).alias("source_attribution"), "n_sources")


def buildings(rows: DataFrame) -> DataFrame:
    return _entities(rows, "building_key", ["street_number", "street_name", "city", "province", "postal_code", "country_code", "latitude", "longitude"])


def units(rows: DataFrame) -> DataFrame:
    return _entities(rows.where("unit_key IS NOT NULL"), "unit_key", ["building_key", "suggested_unit"])


def promote(existing: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The merged entities, and the new ones among found; sources are added to those that exist, without repeats."""
    new = found.join(existing.select("workspace_name", key), ["workspace_name", key], "left_anti")
    return merge(existing, found, ["workspace_name", key], {"source_attribution": APPEND}, default="keep_old"), new
