"""Scalar column functions: normalisation, keys, geography, tolerant casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.profile import POSTAL, CountryProfile, get_profile


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c) -> Column:
    """The string, null if it is empty."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*cs) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[filled(col(c).cast("string")) for c in cs])


def normalize_space(c) -> Column:
    """Runs of Unicode white space become one blank, ends are trimmed; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")), F.lit(""))


def unit_number(c) -> Column:
    return filled(F.trim(F.replace(F.upper(normalize_space(c)), F.lit("#"), F.lit(""))))


def reference_unit(c) -> Column:
    return filled(F.regexp_replace(F.upper(normalize_space(c)), "^#+", ""))


def title_case(c) -> Column:
    """Each run of letters begins upper-case, all else is lower-case (so St. John'S)."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def city_name(c) -> Column:
    return filled(title_case(normalize_space(c)))


def province_code(c, profile: CountryProfile | None = None) -> Column:
    profile = profile or get_profile()
    v = F.replace(F.upper(F.trim(col(c))), F.lit("."), F.lit(""))
    long_names = reduce(lambda w, kv: w.when(v == kv[0], kv[1]), profile.long_provinces.items(), F.when(v.isin(*profile.provinces), v))
    return long_names


def street(c) -> Column:
    return filled(F.upper(normalize_space(c)))


def postal_code(c) -> Column:
    u = F.upper(col(c))
    first = F.regexp_extract(u, POSTAL, 1)
    return F.when(first != "", F.concat(first, F.lit(" "), F.regexp_extract(u, POSTAL, 2)))


def _key_part(c) -> Column:
    return F.upper(normalize_space(c))


def base_key(number, name, city, province, postal) -> Column:
    parts = [_key_part(x) for x in (number, name, city, province)] + [F.replace(_key_part(postal), F.lit(" "), F.lit(""))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def full_key(base, unit) -> Column:
    return F.sha2(F.concat(col(base), F.lit("|"), _key_part(unit)), 256)


def md5_bucket(text: Column, modulo: int) -> Column:
    """md5 of the text as a 128-bit integer, modulo a number: four 32-bit parts folded."""
    h = F.md5(text.cast("binary"))
    out = F.lit(0).cast("long")
    for i in (1, 9, 17, 25):
        out = (out * F.lit(4294967296 % modulo) + F.conv(F.substring(h, i, 8), 16, 10).cast("long")) % F.lit(modulo)
    return out


def holdout_bucket(*parts, salt: str = "eval", modulo: int = 1000) -> Column:
    """Bucket of the filled-in parts and the salt; null parts are left out."""
    named = [F.when(col(p).isNotNull(), normalize_space(col(p).cast("string"))) for p in parts]
    return md5_bucket(F.concat_ws("|", *named, F.lit(salt)), modulo)


def structure_type(text, unit) -> Column:
    return F.when(col(unit).isNull(), "single_unit").when(F.upper(col(text)).rlike("SUITE|STE|OFFICE|DEPT"), "commercial").otherwise("multi_unit")


def haversine_meters(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), F.lit(2.0))
    return F.lit(6371000.0) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def to_double(c, default: float | None = None) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(default).cast("double"))


def is_valid_gps(lat, lon, profile: CountryProfile | None = None) -> Column:
    profile = profile or get_profile()
    a, o = to_double(lat), to_double(lon)
    return F.coalesce(~F.isnan(a) & ~F.isnan(o) & a.between(*profile.latitude) & o.between(*profile.longitude), F.lit(False))


def is_valid_postal(c) -> Column:
    return F.coalesce(F.trim(col(c)).rlike(r"^[A-Z]\d[A-Z]\s*\d[A-Z]\d$"), F.lit(False))


def user_hash(name, phone, salt: str) -> Column:
    """null without a name; a missing phone counts as the text None."""
    return F.when(filled(name).isNotNull(), F.sha2(F.concat(col(name), F.coalesce(col(phone).cast("string"), F.lit("None")), F.lit(salt)), 256))


def frequency_confidence(freqs) -> Column:
    """Share of the most frequent value times one minus the normalised entropy; 0 for an empty array."""
    f = col(freqs)
    total = F.aggregate(f, F.lit(0.0), lambda a, x: a + x)
    entropy = F.aggregate(f, F.lit(0.0), lambda a, x: a - F.when(x > 0, (x / total) * F.ln(x / total)).otherwise(0.0))
    certainty = F.when(F.size(f) > 1, 1 - entropy / F.ln(F.size(f).cast("double"))).otherwise(0.0)
    return F.when((F.size(f) > 0) & (total > 0), F.array_max(f) / total * certainty).otherwise(0.0)


def json_or_empty(c) -> Column:
    return F.coalesce(F.to_json(col(c), {"ignoreNullFields": "false"}), F.lit("{}"))


def dig(json_text, path: str) -> Column:
    return F.get_json_object(col(json_text), "$." + path)


def truthy(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def fsa(postal) -> Column:
    p = F.coalesce(col(postal), F.lit(""))
    return F.when(F.length(p) >= 3, F.upper(F.substring(p, 1, 3))).otherwise("UNK")


def risk_tier(confidence) -> Column:
    c = col(confidence)
    return F.when(c < 0.3, "HIGH").when(c < 0.6, "MEDIUM").otherwise("LOW")


def error_category(field: str, gold, predicted, unit_source=None, text=None) -> Column:
    """The kind of a wrong prediction."""
    g, p = col(gold), col(predicted)
    source = col(unit_source) if unit_source is not None else F.lit(None).cast("string")
    raw = F.upper(F.coalesce(col(text), F.lit(""))) if text is not None else F.lit("")
    if field == "unit_number":
        return (
            F.when(g.isNotNull() & p.isNull() & raw.rlike("#|UNIT|APT|SUITE"), "UNIT_PATTERN_MISS")
            .when(g.isNotNull() & p.isNull(), "REFERENCE_MISSING_UNIT")
            .when((g != p) & source.eqNullSafe(F.lit("simple_fallback")), "UNIT_NORMALIZATION_ERROR")
            .when(g != p, "UNIT_PARSING_CONFLICT")
            .otherwise("GENERAL_MISMATCH")
        )
    if field == "building_type":
        return F.when((g == "commercial") & ~p.eqNullSafe(F.lit("commercial")), "COMMERCIAL_IDENTIFICATION_FAILURE").when((g == "multi_unit") & (p == "single_unit"), "MULTI_UNIT_UNDER_COUNT").otherwise("WRONG_BUILDING_TYPE")
    if field == "decision":
        return F.when((g == "accept") & (p == "review"), "OVER_SENSITIVE_REVIEW").when((g == "review") & (p == "accept"), "UNDETECTED_CONFLICT").otherwise("GENERAL_MISMATCH")
    return F.lit("GENERAL_MISMATCH")
