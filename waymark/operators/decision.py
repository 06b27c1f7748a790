"""Validation: best candidate, reference, decision ladder, keys and hints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import scalars as s
from waymark.functions.profile import CountryProfile
from waymark.operators.candidates import DEFAULT_PARSERS, close_candidates, parsed
from waymark.operators.parsers import once, profile_of
from waymark.operators.reference import match_reference


@dataclass(frozen=True)
class DecisionPolicy:
    """Thresholds and parser weights; immutable, so that nothing leaks between runs."""

    close_candidate_delta: float = 0.08
    commercial_accept: float = 0.88
    multi_unit_accept: float = 0.72
    parser_disagreement_review: float = 0.72
    commercial_review: float = 0.72
    high_confidence_accept: float = 0.82
    moderate_review: float = 0.62
    gps_weak_match: float = 0.62
    gps_conflict: float = 0.5
    parser_weights: dict[str, float] = field(default_factory=dict)


# The reasons of the ladder's branches.
REASONS = {
    "incomplete": "Address is incomplete and needs manual confirmation.",
    "reference_unit": "Reference matched and unit is present.",
    "reference_multi": "Reference matched a multi-unit building; unit may be missing.",
    "reference_commercial": "Reference matched a commercial address; suite or unit details may be missing.",
    "reference": "Reference matched a single-unit building.",
    "commercial": "Commercial address includes a strong suite or room identifier.",
    "multi": "Multi-unit address includes a parsed unit with sufficient parser confidence.",
    "other_unit": "Another strong parser candidate found a likely unit.",
    "disagreement": "Strong parser candidates disagree on the structured address.",
    "commercial_review": "Commercial-looking address parsed well, but unit details may need confirmation.",
    "high": "Parser confidence is high enough without reference confirmation.",
    "moderate": "Parser confidence is moderate; review is safer.",
    "low": "Parser confidence is too low.",
}


def ladder(policy: DecisionPolicy) -> Column:
    """(decision, reason) of a row with street_number, street_name, unit_number, building_type, parse_score, reference_id, alternate_units, parser_disagreement; order matters."""
    ref, unit = F.col("reference_id").isNotNull(), F.col("unit_number").isNotNull()
    kind, at = F.col("building_type"), F.col("parse_score")
    multi, commercial = kind == "multi_unit", kind == "commercial"
    branches = [
        (s.filled("street_number").isNull() | F.col("street_name").isNull(), "review", "incomplete"),
        (ref & unit, "accept", "reference_unit"),
        (ref & multi, "enrich", "reference_multi"),
        (ref & commercial & ~unit, "review", "reference_commercial"),
        (ref, "accept", "reference"),
        (commercial & unit & (at >= policy.commercial_accept), "accept", "commercial"),
        (multi & unit & (at >= policy.multi_unit_accept), "accept", "multi"),
        (~unit & (F.size("alternate_units") > 0) & (multi | commercial), "enrich", "other_unit"),
        (F.col("parser_disagreement") & (at >= policy.parser_disagreement_review), "review", "disagreement"),
        (commercial & (at >= policy.commercial_review), "review", "commercial_review"),
        (at >= policy.high_confidence_accept, "accept", "high"),
        (at >= policy.moderate_review, "review", "moderate"),
    ]
    outcome = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(REASONS[r]).alias("reason"))
    chain = F.when(branches[0][0], outcome(*branches[0][1:]))
    for condition, d, r in branches[1:]:
        chain = chain.when(condition, outcome(d, r))
    return chain.otherwise(outcome("reject", "low"))


def validate(df: DataFrame, references: DataFrame, policy: DecisionPolicy | None = None, profile: CountryProfile | str | None = None, parsers: tuple[str, ...] = DEFAULT_PARSERS, drop_stub: bool = False, localities: tuple[str, ...] = ("city",), observed: tuple[str, ...] = ("city",)) -> DataFrame:
    """Raw addresses with best candidate, reference match, building type, decision, confidence, keys and hints.

    df: workspace_name, raw_id, raw_address_text, city, province, postal_code, country_code, latitude,
    longitude, and what else observed names. Parsing has no shuffle; the reference join is the only one.
    localities, observed: as in match_reference().
    """
    policy, profile = policy or DecisionPolicy(), profile_of(profile)
    return decided(close_candidates(parsed(df, profile, parsers, policy.parser_weights, drop_stub), policy.close_candidate_delta), references, policy, profile, tuple(c for c in observed if c != "city" and c in df.columns), localities, observed)


def decided(out: DataFrame, references: DataFrame, policy, profile: CountryProfile, carried: tuple[str, ...] = (), localities: tuple[str, ...] = ("city",), observed: tuple[str, ...] = ("city",)) -> DataFrame:
    """Decisions of rows that have best, parser_disagreement and alternate_units. policy: thresholds as numbers or columns; carried: columns that stay."""
    p = F.col("best")["parsed"]
    out = once(out, {
        "parser_name": F.col("best")["parser_name"], "parse_score": F.col("best")["score"], "street_number": p["street_number"], "street_name": s.street(p["street_name"]),
        "unit_number": s.unit_number(p["unit_number"]), "parser_base_key": p["base_address_key"],
        "__city": F.coalesce(s.city_name(F.coalesce(p["city"], F.col("city")))), "__province": s.province_code(F.coalesce(p["province"], F.col("province")), profile), "__postal": s.first_filled(p["postal_code"], "postal_code"),
        "parser_disagreement": F.col("parser_disagreement"), "alternate_units": F.col("alternate_units"), **{c: F.col(c) for c in carried},  # all that is used above the generator comes through it
    })
    slim = out.select(*carried, "workspace_name", "raw_id", "raw_address_text", "country_code", "latitude", "longitude", "parser_name", "parse_score", "street_number", "street_name", "unit_number", F.col("__city").alias("city"), F.col("__province").alias("province"), F.col("__postal").alias("postal_code"), "parser_base_key", "parser_disagreement", "alternate_units", "best")  # candidates stay behind
    out = match_reference(slim, references, localities, observed)
    out = out.withColumn("building_type", s.structure_type("raw_address_text", "unit_number"))
    out = out.withColumn("__d", ladder(policy))
    located = F.col("reference_id").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    score = F.coalesce("reference_score", F.lit(0.0))
    weak = located & (score < policy.gps_weak_match)
    complete = s.filled("street_number").isNotNull() & F.col("street_name").isNotNull() & F.col("province").isNotNull()
    out = out.withColumns({
        "decision": F.col("__d.decision"), "reason": F.when(weak, F.concat(F.col("__d.reason"), F.lit(" GPS weakly matches the external reference."))).otherwise(F.col("__d.reason")),
        "confidence": F.round(F.greatest(F.col("parse_score"), score), 4), "canonical_base_key": F.when(complete, s.base_key("street_number", "street_name", "city", "province", "postal_code")),
        "suggested_unit": F.coalesce(F.col("unit_number"), F.get("reference_units", F.lit(0)), F.get("alternate_units", F.lit(0))), "gps_conflict": located & (score < policy.gps_conflict),
    })
    return out.withColumn("canonical_full_key", F.when(F.col("canonical_base_key").isNotNull(), s.full_key("canonical_base_key", "unit_number"))).drop("__d")
