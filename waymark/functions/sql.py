"""Functions for spark.sql: the scalar functions and, as a table function, the candidates of an address.

register(spark) creates temporary SQL functions of the session. Their bodies are SQL, so the optimizer puts them in
place of each call and no Python runs. It turns the lateral join with candidates() into a join of the rows with the
candidates of their distinct arguments, so equal addresses are parsed once, at the price of a shuffle by them;
candidates.candidate_rows() has none.

    SELECT r.raw_id, c.* FROM raw r, LATERAL candidates(r.raw_address_text, r.city, r.province, r.postal_code) c
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from waymark.functions.profile import POSTAL, SIMPLE, CountryProfile, Rule, get_profile


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scalars(profile: CountryProfile) -> dict[str, str]:
    """Signature and body of each function; later ones call earlier ones."""
    long_names = " ".join(f"WHEN v = {_text(k)} THEN {_text(x)}" for k, x in profile.long_provinces.items())
    codes = ", ".join(map(_text, profile.provinces))
    (south, north), (west, east) = profile.latitude, profile.longitude
    return {
        "normalize_space(x STRING) RETURNS STRING": r"coalesce(trim(regexp_replace(x, '(?U)\\s+', ' ')), '')",
        "unit_number(x STRING) RETURNS STRING": "nullif(trim(replace(upper(normalize_space(x)), '#', '')), '')",
        "reference_unit(x STRING) RETURNS STRING": "nullif(regexp_replace(upper(normalize_space(x)), '^#+', ''), '')",
        "city_name(x STRING) RETURNS STRING": r"nullif(array_join(transform(regexp_extract_all(lower(normalize_space(x)), '(\\p{L}+|[^\\p{L}]+)', 1), p -> upper(substring(p, 1, 1)) || substring(p, 2)), ''), '')",
        "known_province(v STRING) RETURNS STRING": f"(CASE WHEN v IN ({codes}) THEN v {long_names} END)",
        "province_code(x STRING) RETURNS STRING": "known_province(replace(upper(trim(x)), '.', ''))",
        "street(x STRING) RETURNS STRING": "nullif(upper(normalize_space(x)), '')",
        "canonical_postal(x STRING) RETURNS STRING": f"nullif(trim(regexp_extract(upper(x), {_text(POSTAL)}, 1) || ' ' || regexp_extract(upper(x), {_text(POSTAL)}, 2)), '')",
        "base_key(n STRING, s STRING, c STRING, p STRING, code STRING) RETURNS STRING": "sha2(concat_ws('|', upper(normalize_space(n)), upper(normalize_space(s)), upper(normalize_space(c)), upper(normalize_space(p)), replace(upper(normalize_space(code)), ' ', '')), 256)",
        "full_key(base STRING, unit STRING) RETURNS STRING": "sha2(base || '|' || upper(normalize_space(unit)), 256)",
        "arc_meters(h DOUBLE) RETURNS DOUBLE": "6371000.0D * 2 * atan2(sqrt(h), sqrt(1 - h))",
        "haversine_meters(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
            "arc_meters(pow(sin((radians(lat2) - radians(lat1)) / 2), 2D) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2D))"
        ),
        "is_valid_gps(lat STRING, lon STRING) RETURNS BOOLEAN": f"coalesce(NOT isnan(try_cast(lat AS DOUBLE)) AND NOT isnan(try_cast(lon AS DOUBLE)) AND try_cast(lat AS DOUBLE) BETWEEN {south} AND {north} AND try_cast(lon AS DOUBLE) BETWEEN {west} AND {east}, false)",
        "is_valid_postal(x STRING) RETURNS BOOLEAN": r"coalesce(trim(x) RLIKE '^[A-Z]\\d[A-Z]\\s*\\d[A-Z]\\d$', false)",
        "fsa(x STRING) RETURNS STRING": "if(length(coalesce(x, '')) >= 3, upper(substring(x, 1, 3)), 'UNK')",
        "risk_tier(x DOUBLE) RETURNS STRING": "if(x < 0.3D, 'HIGH', if(x < 0.6D, 'MEDIUM', 'LOW'))",
    }


def _pieces(number: str, street: str, unit: str, city: str, province: str, postal: str, source: str, parse: float, unit_confidence: float, postal_confidence: float) -> str:
    return f"named_struct('number', {number}, 'street', {street}, 'unit', {unit}, 'city', {city}, 'province', {province}, 'postal', {postal}, 'source', {_text(source)}, 'parse', {parse}D, 'unit_confidence', {unit_confidence}D, 'postal_confidence', {postal_confidence}D)"


_NONE = "CAST(NULL AS STRING)"


def _by(rule: Rule, x: str, city: str, province: str) -> str:
    group = lambda k: f"nullif(regexp_extract({x}, {_text(rule.pattern)}, {k}), '')" if k else _NONE
    return _pieces(group(rule.number), group(rule.street), group(rule.unit), group(rule.city) if rule.city else city, group(rule.province) if rule.province else province, "code", rule.name, rule.parse, rule.unit_confidence, rule.postal)


def candidates(profile: CountryProfile) -> str:
    """The table function: a row for each parser, best first, as candidates.candidate_rows has them."""
    simple = _pieces(f"nullif(regexp_extract(t, {_text(SIMPLE)}, 1), '')", f"nullif(regexp_extract(t, {_text(SIMPLE)}, 2), '')", _NONE, "city", "province", "canonical_postal(t)", "simple_rule", 0.3, 0.1, 0.5)
    rules = " ".join(f"WHEN t RLIKE {_text(r.pattern)} THEN {_by(r, 't', 'city', 'province')}" for r in profile.rules)
    hybrid = f"CASE WHEN tail IS NOT NULL AND bare RLIKE {_text(profile.inline.pattern)} THEN {_by(profile.inline, 'bare', 'own_city', 'own_province')} {rules} ELSE {_pieces(_NONE, _NONE, _NONE, 'city', 'province', 'code', 'fallback', 0.1, 0.1, 0.1)} END"
    stub = _pieces("'123'", "'MAIN ST'", _NONE, "city", "province", "postal_code", "libpostal", 0.9, 0.0, 0.0)
    made = f"array(named_struct('o', 0, 'parser', 'simple_rule', 'p', {simple}), named_struct('o', 1, 'parser', 'hybrid_canada', 'p', {hybrid}), named_struct('o', 2, 'parser', 'libpostal', 'p', {stub}))"
    street = r"nullif(upper(trim(regexp_replace(c.p.street, '(?U)\\s+', ' '))), '')"  # written out, as lambdas can't call SQL functions
    fields = f"named_struct('number', upper(nullif(c.p.number, '')), 'street', {street}, 'postal', c.p.postal)"
    value = "round(least(0.70D * c.p.parse + 0.20D * c.p.unit_confidence + 0.10D * c.p.postal_confidence + if(f.number IS NOT NULL AND f.street IS NOT NULL, 0.05D, 0D) + if(f.postal IS NOT NULL AND f.postal <> '', 0.03D, 0D), 0.99D), 4)"
    default = lambda name, known: f"if(parser = 'libpostal', {name}, coalesce({name}, {_text(known)}))"
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION candidates(address STRING, city STRING, province STRING, postal_code STRING)
RETURNS TABLE(rank INT, parser_name STRING, score DOUBLE, street_number STRING, street_name STRING, unit_number STRING, parsed_city STRING, parsed_province STRING, parsed_postal STRING, unit_source STRING)
RETURN SELECT pos + 1, parser, -x.k, x.f.number, x.f.street, unit_number(p.unit), {default('city_name(p.city)', profile.default_city)}, {default('province_code(p.province)', profile.default_province)}, p.postal, p.source
FROM (SELECT pos, x, x.c.parser AS parser, x.c.p AS p
  FROM (SELECT array_sort(transform(transform(made, c -> named_struct('c', c, 'f', {fields})), y -> named_struct('k', -{value.replace('c.p.', 'y.c.p.').replace('f.', 'y.f.')}, 'o', y.c.o, 'c', y.c, 'f', y.f))) AS ranked
    FROM (SELECT {made} AS made
      FROM (SELECT *, if(endswith(t, tail), rtrim(substring(t, 1, length(t) - length(tail))), t) AS bare
        FROM (SELECT *, ' ' || upper(own_city) || ' ' || own_province AS tail
          FROM (SELECT city, province, postal_code, upper(normalize_space(address)) AS t, canonical_postal(coalesce(nullif(postal_code, ''), upper(normalize_space(address)))) AS code, city_name(city) AS own_city, province_code(province) AS own_province))))) LATERAL VIEW posexplode(ranked) AS pos, x)
"""


def register(spark: SparkSession, profile: CountryProfile | str | None = None) -> list[str]:
    """Creates the functions in the session, for a country profile, and returns their names. Again: they are replaced."""
    profile = profile if isinstance(profile, CountryProfile) else get_profile(profile)
    made = scalars(profile)
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.sql(candidates(profile))
    return [s.split("(")[0] for s in made] + ["candidates"]
