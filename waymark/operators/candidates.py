"""Candidates of all parsers, their scores and the best one, as columns of the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import scalars as s
from waymark.functions.profile import CountryProfile
from waymark.operators.parsers import BARE, PARSERS, finalized, once, profile_of, simple_rule

DEFAULT_PARSERS = tuple(PARSERS)
CLOSE_DELTA = 0.08


def score(parsed: Column, weight: float | Column = 0.0) -> Column:
    part = lambda name: F.coalesce(parsed[name], F.lit(0.0))
    base = F.lit(0.70) * part("parse_confidence") + F.lit(0.20) * part("unit_confidence") + F.lit(0.10) * part("postal_confidence")
    base = base + F.when(parsed["street_number"].isNotNull() & parsed["street_name"].isNotNull(), 0.05).otherwise(0.0)
    base = base + F.when(s.filled(parsed["postal_code"]).isNotNull(), 0.03).otherwise(0.0)
    if isinstance(weight, Column):
        base = base + F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)) * 0.03
    elif weight:
        base = base + F.lit(min(max(float(weight), 0.0), 1.0) * 0.03)
    return F.round(F.least(base, F.lit(0.99)), 4)


def parsed(df: DataFrame, profile: CountryProfile | str | None = None, parsers: tuple[str, ...] = DEFAULT_PARSERS, weights: dict[str, float] | None = None, drop_stub: bool = False) -> DataFrame:
    """df (raw_address_text, city, province, postal_code) with cand_<parser> structs, candidates (best first) and best.

    Unknown parser names are skipped. Candidates of equal score keep the parsers' order.
    """
    profile = profile_of(profile)
    names = [p for p in parsers if p in PARSERS and not (drop_stub and p == "libpostal")]
    if not names:
        raise ValueError("no known parser")
    df = once(df, {"__t": F.upper(s.normalize_space("raw_address_text"))})
    df = once(df, {f"__{n}": PARSERS[n][1](F.col("__t"), F.col("postal_code"), F.col("city"), F.col("province"), profile) for n in names})
    df = once(df, {f"__{n}": finalized(F.col(f"__{n}"), F.col("__t"), profile, n in BARE) for n in names})
    scored = {}
    for k, name in enumerate(names):
        p = F.col(f"__{name}")
        scored[f"cand_{name}"] = F.struct(score(p, (weights or {}).get(name, 0.0)).alias("score"), F.lit(k).alias("ordinal"), F.lit(name).alias("parser_name"), F.lit(PARSERS[name][0]).alias("parser_version"), p.alias("parsed"), F.array(F.lit(name), p["unit_source"]).alias("match_rules"))
    df = once(df, scored).drop("__t", *[f"__{n}" for n in names])
    own = [F.col(f"cand_{n}") for n in names]
    best = reduce(lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a), own)
    return once(df, {"best": best})


def candidate_rows(df: DataFrame, parsers: tuple[str, ...] = DEFAULT_PARSERS) -> DataFrame:
    """A row for each candidate of parsed(): the row's other columns, rank (1: best) and the candidate's fields."""
    own = [c for c in df.columns if c.startswith("cand_")]
    rest = [c for c in df.columns if c not in own and c != "best"]
    ranked = F.sort_array(F.array(*[F.struct((-F.col(c)["score"]).alias("k"), F.col(c)["ordinal"].alias("o"), F.col(c).alias("c")) for c in own]))
    return df.select(*rest, F.posexplode(ranked).alias("pos", "x")).select(*rest, (F.col("pos") + 1).alias("rank"), "x.c.*").drop("ordinal")


def close_candidates(df: DataFrame, delta: float = CLOSE_DELTA) -> DataFrame:
    """df of parsed() with parser_disagreement and alternate_units (three at most)."""
    own = sorted((c for c in df.columns if c.startswith("cand_")), key=lambda c: DEFAULT_PARSERS.index(c[5:]))
    floor = F.greatest(F.col("best")["score"] - delta, F.lit(0.0))
    close = [F.when(F.col(c)["score"] >= floor, F.struct((-F.col(c)["score"]).alias("k"), F.col(c)["ordinal"].alias("o"), F.struct(*[F.coalesce(F.col(c)["parsed"][f], F.lit("")).alias(f) for f in ("street_number", "street_name", "unit_number")]).alias("t"))) for c in own]
    df = once(df, {"__close": F.array_sort(F.array_compact(F.array(*close)))})
    places = F.array_distinct(F.transform("__close", lambda x: x["t"]))
    units = F.filter(F.transform("__close", lambda x: x["t"]["unit_number"]), lambda u: (u != "") & (u != F.coalesce(F.col("best")["parsed"]["unit_number"], F.lit(""))))
    return df.withColumns({"parser_disagreement": F.size(places) >= 2, "alternate_units": F.slice(units, 1, 3)}).drop("__close")


def normalized(df: DataFrame, profile: CountryProfile | str | None = None) -> DataFrame:
    """The quick normalisation: simple parse with the request's city and province, and flags."""
    profile = profile_of(profile)
    t = F.upper(s.normalize_space("raw_address_text"))
    df = once(df, {"__p": finalized(simple_rule(t, F.col("postal_code"), F.col("city"), F.col("province"), profile), t, profile)})
    flag = lambda c, name: F.when(s.filled(c).isNotNull(), F.lit(name))
    flags = F.array_compact(F.array(flag("postal_code", "postal_provided"), flag("city", "city_provided"), flag("province", "province_provided"), flag(F.col("__p")["postal_code"], "postal_detected")))
    return df.withColumns({"normalized": F.col("__p"), "flags": flags}).drop("__p")


def explained(df: DataFrame) -> DataFrame:
    """df of validate() with steps: what led to the decision, in words."""
    steps = [
        F.concat(F.lit("parser "), F.col("best")["parser_name"], F.lit(" scored "), F.col("best")["score"].cast("string")),
        F.when(F.col("reference_id").isNotNull(), F.concat(F.lit("reference matched with "), F.col("reference_score").cast("string"))).otherwise(F.lit("no reference matched")),
        F.concat(F.lit("building type "), F.col("building_type")),
        F.concat(F.lit("decision "), F.col("decision"), F.lit(": "), F.col("reason")),
    ]
    return df.withColumn("steps", F.array_compact(F.array(*steps)))
