"""Address parsers as struct columns: no Python runs on the executors, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import scalars as s
from waymark.functions.profile import SIMPLE, CountryProfile, Rule, get_profile


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if it has fewer (a small file is one task): parsing a row costs far more than moving it. For batches only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_PIECES = ("number", "street", "unit", "city", "province", "postal", "source", "parse", "unit_confidence", "postal_confidence")


def _pieces(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in zip(_PIECES, values)])


def finalized(pieces: Column, text: Column, profile: CountryProfile, bare: bool = False) -> Column:
    """The parsed struct from a parser's pieces; its keys hash what was parsed, before defaults are filled in (bare: neither keys nor defaults)."""
    p = pieces
    none = F.lit(None).cast("string")
    base = none if bare else s.base_key(p["number"], p["street"], p["city"], p["province"], p["postal"])
    city, province = s.city_name(p["city"]), s.province_code(p["province"], profile)
    fields = {
        "normalized_text": text,
        "street_number": F.upper(s.filled(p["number"])),
        "street_name": s.street(p["street"]),
        "unit_number": s.unit_number(p["unit"]),
        "city": city if bare else F.coalesce(city, F.lit(profile.default_city)),
        "province": province if bare else F.coalesce(province, F.lit(profile.default_province)),
        "postal_code": p["postal"],
        "base_address_key": base,
        "full_address_key": none if bare else s.full_key(base, p["unit"]),
        "unit_source": p["source"],
        "feature_vector": F.struct(p["source"].alias("pattern"), F.length(text).alias("text_len"), p["parse"].alias("parse_confidence"), F.lit(profile.country).alias("country")),
        "parse_confidence": p["parse"],
        "unit_confidence": p["unit_confidence"],
        "postal_confidence": p["postal_confidence"],
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _none() -> Column:
    return F.lit(None).cast("string")


def simple_rule(t: Column, postal: Column, city: Column, province: Column, profile: CountryProfile) -> Column:
    """A number followed by a name anywhere in the text (t: upper-case, single blanks)."""
    return _pieces(s.filled(F.regexp_extract(t, SIMPLE, 1)), s.filled(F.regexp_extract(t, SIMPLE, 2)), _none(), city, province, s.postal_code(t), "simple_rule", 0.3, 0.1, 0.5)


def hybrid_canada(t: Column, postal: Column, city: Column, province: Column, profile: CountryProfile) -> Column:
    """An ordered cascade of rules; the first that matches wins."""
    code = s.postal_code(F.coalesce(s.filled(postal), t))
    own_city, own_province = s.city_name(city), s.province_code(province, profile)
    tail = F.concat(F.lit(" "), F.upper(own_city), F.lit(" "), own_province)
    bare = F.when(F.endswith(t, tail), F.rtrim(F.substring(t, F.lit(1), F.length(t) - F.length(tail)))).otherwise(t)

    def by(rule: Rule, x: Column, default_city: Column, default_province: Column) -> Column:
        group = lambda k: s.filled(F.regexp_extract(x, rule.pattern, k)) if k else _none()
        return _pieces(group(rule.number), group(rule.street), group(rule.unit), group(rule.city) if rule.city else default_city, group(rule.province) if rule.province else default_province, code, rule.name, rule.parse, rule.unit_confidence, rule.postal)

    out = F.when(tail.isNotNull() & bare.rlike(profile.inline.pattern), by(profile.inline, bare, own_city, own_province))
    for rule in profile.rules:
        out = out.when(t.rlike(rule.pattern), by(rule, t, city, province))
    return out.otherwise(_pieces(_none(), _none(), _none(), city, province, code, "fallback", 0.1, 0.1, 0.1))


def libpostal(t: Column, postal: Column, city: Column, province: Column, profile: CountryProfile) -> Column:
    """The constant stand-in for an external parser (kept for parity; leave it out with drop_stub)."""
    return _pieces("123", "MAIN ST", _none(), city, province, postal, "libpostal", 0.9, 0.0, 0.0)


#: Parsers by name, in the order that decides ties: version and function of pieces.
PARSERS: dict[str, tuple[str, Callable[..., Column]]] = {
    "simple_rule": ("v1", simple_rule),
    "hybrid_canada": ("v1", hybrid_canada),
    "libpostal": ("native_v1", libpostal),
}
#: Parsers whose results get neither keys nor defaults.
BARE = frozenset({"libpostal"})


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns computed once for the row: a generator of one row keeps the optimizer from copying their expressions into every use."""
    df = df.withColumn("__once", F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
    return df.withColumns({k: F.col("__once")[k] for k in columns}).drop("__once")


def refined(text: Column, parsed: Column) -> Column:
    """Offline stand-in of a language-model refiner: basements are named, everything else goes to review."""
    basement = F.upper(text).contains("BSMT")
    return F.struct(
        F.when(basement, F.lit("BSMT")).otherwise(parsed["unit_number"]).alias("unit_number"),
        F.when(basement, F.lit("multi_unit")).alias("building_type"),
        F.when(basement, F.lit("accept")).otherwise(F.lit("review")).alias("decision"),
    )


def needs_refinement(parse_confidence: Column, is_rural: Column | None = None, threshold: float = 0.6) -> Column:
    rural = F.coalesce(is_rural.cast("int") == 1, F.lit(False)) if is_rural is not None else F.lit(False)
    return (F.coalesce(parse_confidence, F.lit(1.0)) < threshold) | rural


def profile_of(profile: CountryProfile | str | None) -> CountryProfile:
    return profile if isinstance(profile, CountryProfile) else get_profile(profile)
