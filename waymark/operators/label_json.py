"""Labels and payloads as JSON text: values by ordered paths, through variants, so each text is parsed once.

A text that is no JSON, or no object, is no label: all its values are null. As in the original, an empty text,
zero and false count as missing where a later path can fill in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import scalars as s
from waymark.operators.parsers import once

# Where a label has a field, the first that is filled wins.
PATHS = {
    "decision": ("decision",),
    "building_type": ("building_type", "structure_type"),
    "unit_number": ("unit_number", "suggested_unit_number", "canonical.unit_number"),
    "street_name": ("street_name", "canonical.street_name"),
}


def parsed_json(text) -> Column:
    """The text as a variant; null if it is no JSON."""
    return F.try_parse_json(s.col(text))


def value_at(variant: Column, path: str) -> Column:
    """The filled text at a path of a variant; numbers as texts, zero and false as missing."""
    at = F.try_variant_get(variant, f"$.{path}", "variant")
    text = F.try_variant_get(at, "$", "string")
    falsy = (F.schema_of_variant(at) != "STRING") & text.isin("0", "0.0", "false")
    return F.when(~F.coalesce(falsy, F.lit(False)), s.filled(text))


def first_at(variant: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[value_at(variant, p) for p in paths])


def label_value(variant: Column, field: str) -> Column:
    """A field of a label: decision (correct means accept), building_type, unit_number (canonical) or another by its name."""
    value = first_at(variant, PATHS.get(field, (field,)))
    if field == "unit_number":
        return s.unit_number(value)
    if field == "decision":
        value = F.when(F.lower(F.trim(value)) == "correct", F.lit("accept")).otherwise(value)
    return F.trim(value)


def with_labels(gold: DataFrame, text: str = "label_json", fields: tuple[str, ...] = tuple(PATHS)) -> DataFrame:
    """gold with gold_<field> read from its JSON text."""
    rows = once(gold, {"__label": parsed_json(text)})
    return rows.withColumns({f"gold_{f}": label_value(F.col("__label"), f) for f in fields}).drop("__label")


def parse_payload(parser_json, unit_number, confidence) -> Column:
    """What a refiner is shown of a row: the best candidate's parsed values, else the suggested unit and the confidence."""
    whole = parsed_json(parser_json)
    best = F.try_variant_get(whole, "$.best_candidate.parsed", "variant")
    there = F.coalesce(F.schema_of_variant(best).startswith("OBJECT"), F.lit(False))
    at = lambda p: F.try_variant_get(best, f"$.{p}", "string")
    found = F.struct(*[at(p).alias(p) for p in ("street_number", "street_name", "unit_number")], F.try_variant_get(best, "$.parse_confidence", "double").alias("parse_confidence"))
    none = F.lit(None).cast("string")
    other = F.struct(none.alias("street_number"), none.alias("street_name"), s.col(unit_number).alias("unit_number"), F.coalesce(s.col(confidence), F.lit(0.0)).alias("parse_confidence"))
    # an object without best_candidate, or with one that has no parsed values, has an empty payload
    empty = F.struct(none.alias("street_number"), none.alias("street_name"), none.alias("unit_number"), F.lit(None).cast("double").alias("parse_confidence"))
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    other_kind = best.isNotNull() & ~there & ~F.coalesce(F.schema_of_variant(best) == "VOID", F.lit(False))
    return F.when(there, found).when(is_object & ~other_kind, empty).otherwise(other)
