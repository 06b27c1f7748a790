"""Queries over the derived address tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.fixtures import ctes, derived
from waymark.functions import scalars as s
from waymark.functions.profile import COMMERCIAL_HINTS, LONG_PROVINCES, POSTAL, PROVINCES, SIMPLE, TARGET_WORDS, UNIT_HINTS, get_profile
from waymark.functions import sql as sql_functions
from waymark.operators import assets, candidates, evaluate, labels, upsert
from waymark.operators.decision import REASONS, validate
from waymark.operators.models import Model
from waymark.operators.parsers import spread
from waymark.operators.reference import city_compatible, gps_score
from waymark.sources import ingest, tables
from waymark.streaming.cleaning import windowed_counts

# ---- DuckDB fragments ----


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _space(x: str) -> str:
    return f"coalesce(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def _title(x: str) -> str:
    return f"nullif(list_aggregate(list_transform(regexp_extract_all(lower({_space(x)}), '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ''), '')"


def _unit(x: str) -> str:
    return f"nullif(trim(replace(upper({_space(x)}), '#', '')), '')"


def _province(x: str) -> str:
    v = f"replace(upper(trim({x})), '.', '')"
    return f"CASE WHEN {v} IN ({', '.join(map(_q, PROVINCES))}) THEN {v} " + " ".join(f"WHEN {v} = {_q(k)} THEN {_q(c)}" for k, c in LONG_PROVINCES.items()) + " END"


def _street(x: str) -> str:
    return f"nullif(upper({_space(x)}), '')"


def _postal(x: str) -> str:
    return f"CASE WHEN regexp_extract(upper({x}), {_q(POSTAL)}, 1) <> '' THEN regexp_extract(upper({x}), {_q(POSTAL)}, 1) || ' ' || regexp_extract(upper({x}), {_q(POSTAL)}, 2) END"


def _base(n: str, st: str, c: str, p: str, z: str) -> str:
    return "sha256(" + " || '|' || ".join(f"upper({_space(x)})" for x in (n, st, c, p)) + f" || '|' || replace(upper({_space(z)}), ' ', ''))"


def _group(t: str, pattern: str, k: int) -> str:
    return f"nullif(regexp_extract({t}, {_q(pattern)}, {k}), '')" if k else "NULL"


def _hybrid() -> str:
    """Columns of the hybrid parser over norm."""
    profile = get_profile()
    cases = [("tail IS NOT NULL AND regexp_matches(bare, " + _q(profile.inline.pattern) + ")", profile.inline, "bare")]
    cases += [(f"regexp_matches(t, {_q(r.pattern)})", r, "t") for r in profile.rules]
    pick = lambda f, other: "CASE " + " ".join(f"WHEN rule = {k} THEN {f(r, x)}" for k, (_, r, x) in enumerate(cases)) + f" ELSE {other} END"
    rule = "CASE " + " ".join(f"WHEN {c} THEN {k}" for k, (c, _, _) in enumerate(cases)) + " ELSE -1 END"
    columns = {
        "h_source": pick(lambda r, x: _q(r.name), "'fallback'"), "h_num": pick(lambda r, x: _group(x, r.pattern, r.number), "NULL"), "h_st": pick(lambda r, x: _group(x, r.pattern, r.street), "NULL"),
        "h_unit": pick(lambda r, x: _group(x, r.pattern, r.unit), "NULL"), "h_city": pick(lambda r, x: _group(x, r.pattern, r.city) if r.city else ("ncity" if x == "bare" else "city"), "city"),
        "h_prov": pick(lambda r, x: _group(x, r.pattern, r.province) if r.province else ("nprov" if x == "bare" else "province"), "province"),
        "h_pc": pick(lambda r, x: f"CAST({r.parse} AS DOUBLE)", "CAST(0.1 AS DOUBLE)"), "h_uc": pick(lambda r, x: f"CAST({r.unit_confidence} AS DOUBLE)", "CAST(0.1 AS DOUBLE)"), "h_oc": pick(lambda r, x: f"CAST({r.postal} AS DOUBLE)", "CAST(0.1 AS DOUBLE)"),
    }
    body = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"ruled AS (SELECT *, {rule} AS rule FROM norm), hyb AS (SELECT *, {body}, {_postal('coalesce(nullif(postal_code, chr(0)), t)')} AS h_postal FROM ruled)".replace("chr(0)", "''")


def _score(p: str, u: str, o: str, num: str, st: str, postal: str) -> str:
    d = lambda v: f"CAST({v} AS DOUBLE)"
    return f"round(least({d(0.70)} * {p} + {d(0.20)} * {u} + {d(0.10)} * {o} + CASE WHEN {num} IS NOT NULL AND {st} IS NOT NULL THEN {d(0.05)} ELSE {d(0)} END + CASE WHEN {postal} IS NOT NULL THEN {d(0.03)} ELSE {d(0)} END, {d(0.99)}), 4)"


_NORM = f"""norm0 AS (SELECT *, upper({_space('raw_address_text')}) AS t, {_title('city')} AS ncity, {_province('province')} AS nprov FROM raw),
norm1 AS (SELECT *, ' ' || upper(ncity) || ' ' || nprov AS tail FROM norm0),
norm AS (SELECT *, CASE WHEN tail IS NOT NULL AND ends_with(t, tail) THEN rtrim(t[1:length(t) - length(tail)]) ELSE t END AS bare FROM norm1)"""

_PARSED = f"""{_NORM}, {_hybrid()},
par AS (SELECT *, nullif(regexp_extract(t, {_q(SIMPLE)}, 1), '') AS s_num, {_street(f"nullif(regexp_extract(t, {_q(SIMPLE)}, 2), '')")} AS s_st, {_postal('t')} AS s_postal,
  upper(h_num) AS p_num, {_street('h_st')} AS p_st, {_unit('h_unit')} AS p_unit, coalesce({_title('h_city')}, 'Halifax') AS p_city, coalesce({_province('h_prov')}, 'NS') AS p_prov FROM hyb),
sc AS (SELECT *, {_score('0.3::DOUBLE', '0.1::DOUBLE', '0.5::DOUBLE', 's_num', 's_st', 's_postal')} AS s_score, {_score('h_pc', 'h_uc', 'h_oc', 'p_num', 'p_st', 'h_postal')} AS h_score,
  {_score('0.9::DOUBLE', '0::DOUBLE', '0::DOUBLE', "'123'", "'MAIN ST'", "nullif(postal_code, '')")} AS l_score FROM par),
bst AS (SELECT *, CASE WHEN l_score > greatest(s_score, h_score) THEN 'libpostal' WHEN h_score > s_score THEN 'hybrid_canada' ELSE 'simple_rule' END AS parser_name, greatest(s_score, h_score, l_score) AS parse_score FROM sc),
b AS (SELECT workspace_name, raw_id, raw_address_text, country_code, latitude, longitude, parser_name, parse_score,
  CASE parser_name WHEN 'libpostal' THEN '123' WHEN 'hybrid_canada' THEN p_num ELSE s_num END AS street_number, CASE parser_name WHEN 'libpostal' THEN 'MAIN ST' WHEN 'hybrid_canada' THEN p_st ELSE s_st END AS street_name,
  CASE parser_name WHEN 'hybrid_canada' THEN p_unit END AS unit_number, CASE parser_name WHEN 'libpostal' THEN ncity WHEN 'hybrid_canada' THEN {_title('p_city')} ELSE coalesce(ncity, 'Halifax') END AS city,
  CASE parser_name WHEN 'libpostal' THEN nprov WHEN 'hybrid_canada' THEN p_prov ELSE coalesce(nprov, 'NS') END AS province,
  coalesce(CASE parser_name WHEN 'libpostal' THEN postal_code WHEN 'hybrid_canada' THEN h_postal ELSE s_postal END, postal_code) AS postal_code,
  (s_score >= floor_ AND (coalesce(s_num, ''), coalesce(s_st, ''), '') <> (CASE parser_name WHEN 'libpostal' THEN '123' WHEN 'hybrid_canada' THEN coalesce(p_num, '') ELSE coalesce(s_num, '') END, CASE parser_name WHEN 'libpostal' THEN 'MAIN ST' WHEN 'hybrid_canada' THEN coalesce(p_st, '') ELSE coalesce(s_st, '') END, CASE parser_name WHEN 'hybrid_canada' THEN coalesce(p_unit, '') ELSE '' END))
   OR (h_score >= floor_ AND parser_name <> 'hybrid_canada' AND (coalesce(p_num, ''), coalesce(p_st, ''), coalesce(p_unit, '')) <> (CASE parser_name WHEN 'libpostal' THEN '123' ELSE coalesce(s_num, '') END, CASE parser_name WHEN 'libpostal' THEN 'MAIN ST' ELSE coalesce(s_st, '') END, ''))
   OR (l_score >= floor_ AND parser_name <> 'libpostal' AND ('123', 'MAIN ST', '') <> (CASE parser_name WHEN 'hybrid_canada' THEN coalesce(p_num, '') ELSE coalesce(s_num, '') END, CASE parser_name WHEN 'hybrid_canada' THEN coalesce(p_st, '') ELSE coalesce(s_st, '') END, CASE parser_name WHEN 'hybrid_canada' THEN coalesce(p_unit, '') ELSE '' END)) AS parser_disagreement,
  CASE WHEN h_score >= floor_ AND parser_name <> 'hybrid_canada' THEN p_unit END AS alternate_unit FROM (SELECT *, greatest(parse_score - CAST(0.08 AS DOUBLE), 0) AS floor_ FROM bst))"""

_HAVERSINE = "CAST(6371000 AS DOUBLE) * 2 * atan2(sqrt(h_), sqrt(1 - h_))"
_WORDS = lambda c: f"list_distinct(string_split(upper({c}), ' '))"
_MATCH = f"""pr AS (SELECT b.raw_id, reference_id, r.external_id, upper(trim(r.unit_number)) AS ru, quality_score, reference_lat, reference_lon, latitude, longitude, {_title('b.city')} AS c1, {_title('r.city')} AS c2,
  pow(sin((radians(reference_lat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(reference_lat)) * pow(sin((radians(reference_lon) - radians(longitude)) / 2), 2) AS h_
  FROM b JOIN reference r ON r.is_active AND b.workspace_name = r.workspace_name AND upper(b.street_number) = upper(r.street_number) AND upper(b.street_name) = upper(r.street_name) AND upper(b.province) = upper(r.province)),
ps AS (SELECT *, round(CAST(0.45 AS DOUBLE) * CASE WHEN c1 IS NULL OR c2 IS NULL OR c1 = c2 OR (len(list_intersect({_WORDS('c1')}, {_WORDS('c2')})) > 0 AND CAST(len(list_intersect({_WORDS('c1')}, {_WORDS('c2')})) AS DOUBLE) / least(len({_WORDS('c1')}), len({_WORDS('c2')})) >= 0.5) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CAST(0.30 AS DOUBLE) * CASE WHEN reference_lat IS NULL OR reference_lon IS NULL THEN CAST(0.25 AS DOUBLE) WHEN latitude IS NULL OR longitude IS NULL THEN CAST(0.55 AS DOUBLE) WHEN {_HAVERSINE} <= 20 THEN CAST(1.0 AS DOUBLE) WHEN {_HAVERSINE} <= 60 THEN CAST(0.9 AS DOUBLE) WHEN {_HAVERSINE} <= 120 THEN CAST(0.78 AS DOUBLE) WHEN {_HAVERSINE} <= 250 THEN CAST(0.62 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END
  + CAST(0.25 AS DOUBLE) * coalesce(quality_score, 0), 4) AS score FROM pr),
rk AS (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY score DESC, reference_id) AS k, count(*) OVER (PARTITION BY raw_id) AS n FROM ps),
un AS (SELECT raw_id, list_sort(list_distinct(list(ru) FILTER (ru <> ''))) AS units FROM ps GROUP BY raw_id),
mt AS (SELECT rk.raw_id, reference_id, external_id AS reference_external_id, score AS reference_score, n AS reference_candidates, units FROM rk JOIN un ON rk.raw_id = un.raw_id WHERE k = 1 AND score > 0 AND score >= CASE WHEN n = 1 THEN CAST(0.70 AS DOUBLE) ELSE CAST(0.78 AS DOUBLE) END)"""


def _ladder() -> str:
    branches = [
        ("street_number IS NULL OR street_name IS NULL", "review", "incomplete"), ("ref AND unit_number IS NOT NULL", "accept", "reference_unit"), ("ref AND building_type = 'multi_unit'", "enrich", "reference_multi"),
        ("ref AND building_type = 'commercial'", "review", "reference_commercial"), ("ref", "accept", "reference"), ("building_type = 'commercial' AND parse_score >= CAST(0.88 AS DOUBLE)", "accept", "commercial"),
        ("building_type = 'multi_unit' AND parse_score >= CAST(0.72 AS DOUBLE)", "accept", "multi"), ("parser_disagreement AND parse_score >= CAST(0.72 AS DOUBLE)", "review", "disagreement"),
        ("building_type = 'commercial' AND parse_score >= CAST(0.72 AS DOUBLE)", "review", "commercial_review"), ("parse_score >= CAST(0.82 AS DOUBLE)", "accept", "high"), ("parse_score >= CAST(0.62 AS DOUBLE)", "review", "moderate"),
    ]
    d = "CASE " + " ".join(f"WHEN {c} THEN {_q(x)}" for c, x, _ in branches) + " ELSE 'reject' END AS decision"
    r = "CASE " + " ".join(f"WHEN {c} THEN {_q(REASONS[x])}" for c, _, x in branches) + f" ELSE {_q(REASONS['low'])} END AS reason"
    return f"{d}, {r}"


_VALID = f"""{_PARSED}, {_MATCH},
j AS (SELECT b.*, mt.reference_id, mt.reference_external_id, mt.reference_score, mt.reference_candidates, mt.units, mt.reference_id IS NOT NULL AS ref,
  CASE WHEN unit_number IS NULL THEN 'single_unit' WHEN regexp_matches(upper(raw_address_text), 'SUITE|STE|OFFICE|DEPT') THEN 'commercial' ELSE 'multi_unit' END AS building_type FROM b LEFT JOIN mt ON b.raw_id = mt.raw_id),
v AS (SELECT *, {_ladder()}, round(greatest(parse_score, coalesce(reference_score, CAST(0 AS DOUBLE))), 4) AS confidence,
  CASE WHEN street_number IS NOT NULL AND street_name IS NOT NULL AND province IS NOT NULL THEN {_base('street_number', 'street_name', 'city', 'province', 'postal_code')} END AS canonical_base_key,
  coalesce(unit_number, units[1], alternate_unit) AS suggested_unit FROM j)"""

def _swapped(text: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        if a not in text:
            raise ValueError(f"not in the SQL: {a}")
        text = text.replace(a, b)
    return text


def _models(models: list[Model], over: dict[str, float] | None = None) -> str:
    """_VALID with a row v for each row and model: mdl lists the models' parsers, weights and thresholds; a parser that a model leaves out scores -1."""
    d = lambda v: f"CAST({v} AS DOUBLE)"
    names = {"simple_rule": "s", "hybrid_canada": "h", "libpostal": "l"}
    columns = ["model", *[f"{k}_{x}" for x in names.values() for k in ("use", "w")], "t_delta", "t_commercial", "t_multi", "t_disagree", "t_creview", "t_high", "t_moderate"]
    rows = []
    for m in models:
        p = m.policy
        weights = {**p.parser_weights, **(over or {})}
        flags = [v for n in names for v in (str(n in m.parsers).lower(), d(min(max(weights.get(n, 0.0), 0.0), 1.0)))]
        numbers = [p.close_candidate_delta, p.commercial_accept, p.multi_unit_accept, p.parser_disagreement_review, p.commercial_review, p.high_confidence_accept, p.moderate_review]
        rows.append(f"({', '.join([_q(m.name), *flags, *map(d, numbers)])})")
    mdl = f"mdl({', '.join(columns)}) AS (VALUES {', '.join(rows)})"
    scored = _PARSED
    for x in ("s", "h", "l"):
        at = scored.index(f" AS {x}_score")
        start = scored.rindex("round(least(", 0, at)
        old = scored[start:at]
        new = old.replace(", CAST(0.99 AS DOUBLE)), 4)", f" + w_{x} * {d(0.03)}, CAST(0.99 AS DOUBLE)), 4)")
        scored = scored[:start] + f"CASE WHEN use_{x} THEN {new} ELSE -1 END" + scored[at:]
    scored = _swapped(scored, ("AS l_score FROM par)", "AS l_score FROM par CROSS JOIN mdl)"), ("b AS (SELECT workspace_name,", "b AS (SELECT model, workspace_name,"), ("parse_score - CAST(0.08 AS DOUBLE)", "parse_score - t_delta"))
    matched = _swapped(
        _MATCH, ("pr AS (SELECT b.raw_id,", "pr AS (SELECT b.model, b.raw_id,"), ("PARTITION BY raw_id", "PARTITION BY model, raw_id"), ("un AS (SELECT raw_id,", "un AS (SELECT model, raw_id,"), ("FROM ps GROUP BY raw_id", "FROM ps GROUP BY model, raw_id"),
        ("mt AS (SELECT rk.raw_id,", "mt AS (SELECT rk.model, rk.raw_id,"), ("ON rk.raw_id = un.raw_id", "ON rk.model = un.model AND rk.raw_id = un.raw_id"),
    )
    valid = _swapped(
        _VALID[len(f"{_PARSED}, {_MATCH},") :], ("FROM b LEFT JOIN mt ON b.raw_id = mt.raw_id", "FROM b LEFT JOIN mt ON b.model = mt.model AND b.raw_id = mt.raw_id"), ("FROM j)", "FROM j JOIN mdl USING (model))"),
        ("'commercial' AND parse_score >= CAST(0.88 AS DOUBLE)", "'commercial' AND parse_score >= t_commercial"), ("'multi_unit' AND parse_score >= CAST(0.72 AS DOUBLE)", "'multi_unit' AND parse_score >= t_multi"),
        ("parser_disagreement AND parse_score >= CAST(0.72 AS DOUBLE)", "parser_disagreement AND parse_score >= t_disagree"), ("'commercial' AND parse_score >= CAST(0.72 AS DOUBLE)", "'commercial' AND parse_score >= t_creview"),
        ("parse_score >= CAST(0.82 AS DOUBLE)", "parse_score >= t_high"), ("parse_score >= CAST(0.62 AS DOUBLE)", "parse_score >= t_moderate"),
        ("WHEN parser_disagreement AND", "WHEN unit_number IS NULL AND alternate_unit IS NOT NULL AND building_type IN ('multi_unit', 'commercial') THEN 'enrich' WHEN parser_disagreement AND"),
    )
    return f"{mdl}, {scored}, {matched}, {valid}"


# ---- queries ----

Q: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _raw(spark, d):
    return spread(derived(spark, d, "raw"))


def _validated(spark, d):
    return validate(_raw(spark, d), derived(spark, d, "reference"))


@_query("normalize", f"WITH {ctes('raw')} SELECT raw_id, {_space('raw_address_text')} AS text, {_title('city')} AS city, {_province('province')} AS province, {_postal('raw_address_text')} AS postal, {_unit('raw_address_text')} AS unit, {_street('raw_address_text')} AS street, {_base('raw_id::VARCHAR', 'raw_address_text', 'city', 'province', 'postal_code')} AS base_key FROM raw")
def _normalize(spark, d):
    t = F.col("raw_address_text")
    return derived(spark, d, "raw").select("raw_id", s.normalize_space(t).alias("text"), s.city_name("city").alias("city"), s.province_code("province").alias("province"), s.postal_code(t).alias("postal"), s.unit_number(t).alias("unit"), s.street(t).alias("street"), s.base_key(F.col("raw_id").cast("string"), t, "city", "province", "postal_code").alias("base_key"))


@_query("simple_parse", f"WITH {ctes('raw')}, {_PARSED} SELECT raw_id, s_num AS street_number, s_st AS street_name, s_postal AS postal_code, s_score AS score FROM sc")
def _simple(spark, d):
    c = F.col("cand_simple_rule")
    return candidates.parsed(_raw(spark, d), parsers=("simple_rule",)).select("raw_id", c["parsed"]["street_number"].alias("street_number"), c["parsed"]["street_name"].alias("street_name"), c["parsed"]["postal_code"].alias("postal_code"), c["score"].alias("score"))


@_query("hybrid_parse", f"WITH {ctes('raw')}, {_PARSED} SELECT raw_id, p_num AS street_number, p_st AS street_name, p_unit AS unit_number, p_city AS city, p_prov AS province, h_postal AS postal_code, h_source AS unit_source, h_score AS score, {_base('h_num', 'h_st', 'h_city', 'h_prov', 'h_postal')} AS base_address_key FROM sc")
def _hybrid_query(spark, d):
    c = F.col("cand_hybrid_canada")
    names = ("street_number", "street_name", "unit_number", "city", "province", "postal_code", "unit_source", "base_address_key")
    return candidates.parsed(_raw(spark, d), parsers=("hybrid_canada",)).select("raw_id", *[c["parsed"][n].alias(n) for n in names], c["score"].alias("score"))


@_query("parse_best", f"WITH {ctes('raw')}, {_PARSED} SELECT raw_id, parser_name, parse_score, parser_disagreement, alternate_unit FROM b")
def _best(spark, d):
    out = candidates.close_candidates(candidates.parsed(_raw(spark, d)))
    return out.select("raw_id", F.col("best")["parser_name"].alias("parser_name"), F.col("best")["score"].alias("parse_score"), "parser_disagreement", F.get("alternate_units", F.lit(0)).alias("alternate_unit"))


@_query("candidate_ranking", f"WITH {ctes('raw')}, {_PARSED}, l AS (SELECT raw_id, 0 AS o, 'simple_rule' AS parser_name, s_score AS score FROM sc UNION ALL SELECT raw_id, 1, 'hybrid_canada', h_score FROM sc UNION ALL SELECT raw_id, 2, 'libpostal', l_score FROM sc) SELECT raw_id, CAST(row_number() OVER (PARTITION BY raw_id ORDER BY score DESC, o) AS INTEGER) AS rank, parser_name, score FROM l")
def _ranking(spark, d):
    return candidates.candidate_rows(candidates.parsed(_raw(spark, d))).select("raw_id", "rank", "parser_name", "score")


@_query("sql_candidates", SQL["candidate_ranking"])
def _sql_candidates(spark, d):
    sql_functions.register(spark)
    return spark.sql("SELECT r.raw_id, c.rank, c.parser_name, c.score FROM {raw} r, LATERAL candidates(r.raw_address_text, r.city, r.province, r.postal_code) c", raw=_raw(spark, d))


@_query("reference_match", f"WITH {ctes('raw', 'reference')}, {_PARSED}, {_MATCH} SELECT raw_id, reference_id, reference_score, reference_candidates, coalesce(array_to_string(units, ','), '') AS units FROM mt")
def _reference(spark, d):
    return _validated(spark, d).where("reference_id IS NOT NULL").select("raw_id", "reference_id", "reference_score", "reference_candidates", F.array_join("reference_units", ",").alias("units"))


@_query("validate_decision", f"WITH {ctes('raw', 'reference')}, {_VALID} SELECT raw_id, parser_name, parse_score, building_type, decision, reason, confidence, street_number, street_name, unit_number, city, province, postal_code, suggested_unit, canonical_base_key FROM v")
def _decision(spark, d):
    return _validated(spark, d).select("raw_id", "parser_name", "parse_score", "building_type", "decision", "reason", "confidence", "street_number", "street_name", "unit_number", "city", "province", "postal_code", "suggested_unit", "canonical_base_key")


@_query("decision_distribution", f"WITH {ctes('raw', 'reference')}, {_VALID} SELECT province, decision, count(*) AS n FROM v GROUP BY province, decision")
def _distribution(spark, d):
    return _validated(spark, d).groupBy("province", "decision").agg(F.count(F.lit(1)).alias("n"))


_PROMOTE = f"{_VALID}, pm AS (SELECT *, coalesce(sha256('REF|' || coalesce(country_code, 'CA') || '|' || reference_external_id), canonical_base_key) AS building_key FROM v WHERE decision = 'accept' AND confidence >= CAST(0.85 AS DOUBLE) AND canonical_base_key IS NOT NULL)"


@_query("canonical_building", f"WITH {ctes('raw', 'reference')}, {_PROMOTE} SELECT building_key, min(raw_id) AS first_raw_id, arg_min(street_number, raw_id) AS street_number, arg_min(street_name, raw_id) AS street_name, count(*) AS n_sources FROM pm GROUP BY building_key")
def _building(spark, d):
    return assets.buildings(assets.promotable(_validated(spark, d))).select("building_key", F.element_at("source_attribution", 1).cast("long").alias("first_raw_id"), "street_number", "street_name", "n_sources")


@_query("canonical_unit", f"WITH {ctes('raw', 'reference')}, {_PROMOTE} SELECT sha256(building_key || '|' || suggested_unit) AS unit_key, building_key, suggested_unit, count(*) AS n_sources FROM pm WHERE suggested_unit IS NOT NULL GROUP BY ALL")
def _units(spark, d):
    return assets.units(assets.promotable(_validated(spark, d))).select("unit_key", "building_key", "suggested_unit", "n_sources")


@_query("upsert_raw", f"WITH {ctes('raw')}, o AS (SELECT external_id, raw_address_text, city FROM raw WHERE raw_id % 3 <> 0), n AS (SELECT external_id, upper(raw_address_text) AS raw_address_text, CASE WHEN raw_id % 4 = 0 THEN city END AS city FROM raw WHERE raw_id % 2 = 0) SELECT coalesce(o.external_id, n.external_id) AS external_id, CASE WHEN n.external_id IS NOT NULL THEN n.raw_address_text ELSE o.raw_address_text END AS raw_address_text, coalesce(n.city, o.city) AS city FROM o FULL OUTER JOIN n ON o.external_id = n.external_id")
def _upsert(spark, d):
    raw = derived(spark, d, "raw").select("external_id", "raw_id", "raw_address_text", "city")
    old = raw.where("raw_id % 3 <> 0").drop("raw_id")
    new = raw.where("raw_id % 2 = 0").select("external_id", F.upper("raw_address_text").alias("raw_address_text"), F.when(F.col("raw_id") % 4 == 0, F.col("city")).alias("city"))
    return upsert.merge(old, new, ["external_id"], {"city": upsert.COALESCE})


@_query("keyset_page", f"WITH {ctes('raw')} SELECT raw_id, external_id FROM raw WHERE raw_id > 500 ORDER BY raw_id LIMIT 1000")
def _page(spark, d):
    return ingest.page(derived(spark, d, "raw"), "raw_id", "external_id", (500, "~"), 1000).select("raw_id", "external_id")


_SPLIT = f"CAST((('0x' || md5(concat_ws('|', workspace_name, source_name, source_id, task_type, 'g1', 's1', 'eval')))::uhugeint) % 100 AS BIGINT)"


@_query("gold_split", f"WITH {ctes('gold')}, x AS (SELECT gold_label_id, {_SPLIT} AS bucket FROM gold WHERE review_status = 'accepted' AND label_source = 'human') SELECT gold_label_id, bucket, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'eval' ELSE 'test' END AS split FROM x")
def _split(spark, d):
    return labels.gold_split(derived(spark, d, "gold"), "g1", "s1").select("gold_label_id", "bucket", "split")


@_query("gold_snapshot", f"WITH {ctes('gold')}, x AS (SELECT *, {_SPLIT} AS b FROM gold WHERE review_status = 'accepted' AND label_source = 'human') SELECT workspace_name, task_type, count(*) AS label_count, count(*) FILTER (b < 80) AS train_count, count(*) FILTER (b >= 80 AND b < 90) AS eval_count, count(*) FILTER (b >= 90) AS test_count FROM x GROUP BY ALL")
def _snapshot(spark, d):
    return labels.snapshot(labels.gold_split(derived(spark, d, "gold"), "g1", "s1"))


@_query("stratified_seed", f"WITH {ctes('result')}, x AS (SELECT *, row_number() OVER (PARTITION BY building_type ORDER BY confidence NULLS FIRST, raw_id) AS r FROM result WHERE confidence <= CAST(0.65 AS DOUBLE) OR decision = 'review') SELECT raw_id, building_type, CAST(r AS INTEGER) AS rank, CAST(round_even((1 - coalesce(confidence, 0)) * 100, 0) AS INTEGER) AS priority FROM x WHERE r <= CASE building_type WHEN 'commercial' THEN 40 ELSE 80 END")
def _stratified(spark, d):
    return labels.stratified_seed(derived(spark, d, "result"), 200).select("raw_id", "building_type", "rank", "priority")


_TARGETED = f"""WITH {ctes('raw', 'result')}
SELECT r.raw_id, building_type, CASE building_type WHEN 'commercial' THEN 95 WHEN 'multi_unit' THEN 90 ELSE 85 END AS priority
FROM result r JOIN raw USING (raw_id)
WHERE (building_type IN ('commercial', 'multi_unit') OR unit_number IS NOT NULL OR regexp_matches(upper(raw_address_text), {_q(TARGET_WORDS)}))
  AND (confidence <= CAST(0.80 AS DOUBLE) OR decision = 'review')
ORDER BY CASE WHEN building_type = 'commercial' THEN 0 WHEN building_type = 'multi_unit' THEN 1 WHEN unit_number IS NOT NULL THEN 2 ELSE 3 END, confidence NULLS FIRST, r.raw_id DESC
LIMIT 300"""


@_query("targeted_seed", _TARGETED)
def _targeted(spark, d):
    rows = derived(spark, d, "result").withColumnRenamed("unit_number", "suggested_unit_number")
    rows = rows.join(derived(spark, d, "raw").select("raw_id", "raw_address_text"), "raw_id")
    return labels.targeted_seed(rows, 300).select("raw_id", "building_type", "priority")


_HINTED = " OR ".join(f"contains(upper(coalesce(raw_address_text, '')), {_q(w)})" for w in (*UNIT_HINTS, *COMMERCIAL_HINTS))
_PRESCREEN = f"(coalesce(confidence, 0) <= CAST(0.72 AS DOUBLE) OR coalesce(building_type IN ('commercial', 'multi_unit'), false) OR {_HINTED})"


@_query("prescreen_flags", f"""WITH {ctes('raw', 'result')}
SELECT r.raw_id, {_PRESCREEN} AS prescreen,
  CASE WHEN confidence < CAST(0.3 AS DOUBLE) THEN 'HIGH' WHEN confidence < CAST(0.6 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM result r JOIN raw USING (raw_id)""")
def _prescreen(spark, d):
    rows = derived(spark, d, "result").join(derived(spark, d, "raw").select("raw_id", "raw_address_text"), "raw_id")
    return rows.select("raw_id", labels.needs_prescreen(F.lit("decision"), "confidence", "building_type", "raw_address_text").alias("prescreen"), s.risk_tier("confidence").alias("tier"))


@_query("silver_labels", f"WITH {ctes('raw', 'reference')} SELECT raw_id, reference_id, r.street_number FROM raw JOIN reference r ON upper(raw.postal_code) = upper(r.postal_code) AND upper(raw.city) = upper(r.city) WHERE raw.is_active")
def _silver(spark, d):
    return labels.silver_labels(derived(spark, d, "raw"), derived(spark, d, "reference")).select("raw_id", "reference_id", "label.street_number")


def _compared(spark, d):
    return evaluate.gold_compare(derived(spark, d, "gold"), derived(spark, d, "raw"), derived(spark, d, "result"))


_U = lambda c: _unit(f"nullif(trim({c}), '')")
_COMPARE = f"""cmp AS (SELECT g.gold_label_id, g.source_id, raw.raw_id, raw_address_text, confidence, unit_source, CASE WHEN lower(gold_decision) = 'correct' THEN 'accept' ELSE gold_decision END AS g_decision, gold_building_type AS g_building_type, {_U('gold_unit_number')} AS g_unit_number,
  decision AS p_decision, building_type AS p_building_type, {_U('unit_number')} AS p_unit_number FROM gold g LEFT JOIN raw ON g.workspace_name = raw.workspace_name AND (CAST(raw.raw_id AS VARCHAR) = g.source_id OR raw.external_id = g.source_id) LEFT JOIN result r ON r.raw_id = raw.raw_id WHERE review_status = 'accepted' AND label_source = 'human'),
lng AS (SELECT gold_label_id, source_id, raw_address_text, unit_source, 'decision' AS field, g_decision AS g, p_decision AS p FROM cmp UNION ALL SELECT gold_label_id, source_id, raw_address_text, unit_source, 'building_type', g_building_type, p_building_type FROM cmp UNION ALL SELECT gold_label_id, source_id, raw_address_text, unit_source, 'unit_number', g_unit_number, p_unit_number FROM cmp)"""
_RATES = """round(coalesce(tp / nullif(total, 0), 0), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall"""


@_query("gold_compare", f"WITH {ctes('gold', 'raw', 'result')}, {_COMPARE} SELECT gold_label_id, raw_id, g_decision, p_decision, g_unit_number, p_unit_number FROM cmp")
def _gold_compare(spark, d):
    v = evaluate.gold_value
    return _compared(spark, d).select("gold_label_id", "raw_id", v("decision", "gold_decision").alias("g_decision"), v("decision", "pred_decision").alias("p_decision"), v("unit_number", "gold_unit_number").alias("g_unit_number"), v("unit_number", "pred_unit_number").alias("p_unit_number"))


@_query("field_metrics", f"WITH {ctes('gold', 'raw', 'result')}, {_COMPARE}, k AS (SELECT field, count(g) AS total, count(*) - count(g) AS skipped, count(*) FILTER (g = p) AS tp, count(*) FILTER (g <> p) AS fp, count(*) FILTER (g IS NOT NULL AND g IS DISTINCT FROM p) AS fn FROM lng GROUP BY field), m AS (SELECT *, {_RATES} FROM k) SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 4) AS f1 FROM m")
def _field_metrics(spark, d):
    return evaluate.field_metrics(_compared(spark, d))


@_query("commercial_metrics", f"WITH {ctes('gold', 'raw', 'result')}, {_COMPARE}, k AS (SELECT count(*) AS total, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM (SELECT g_building_type = 'commercial' AS g, coalesce(p_building_type = 'commercial', false) AS p FROM cmp WHERE g_building_type IS NOT NULL)), m AS (SELECT *, round(coalesce((tp + tn) / nullif(total, 0), 0), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall FROM k) SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 4) AS f1 FROM m")
def _commercial(spark, d):
    return evaluate.label_metrics(_compared(spark, d), "building_type", "commercial")


_CATEGORY = """CASE field WHEN 'unit_number' THEN CASE WHEN g IS NOT NULL AND p IS NULL AND regexp_matches(upper(coalesce(raw_address_text, '')), '#|UNIT|APT|SUITE') THEN 'UNIT_PATTERN_MISS' WHEN g IS NOT NULL AND p IS NULL THEN 'REFERENCE_MISSING_UNIT' WHEN g <> p AND unit_source IS NOT DISTINCT FROM 'simple_fallback' THEN 'UNIT_NORMALIZATION_ERROR' WHEN g <> p THEN 'UNIT_PARSING_CONFLICT' ELSE 'GENERAL_MISMATCH' END
 WHEN 'building_type' THEN CASE WHEN g = 'commercial' AND p IS DISTINCT FROM 'commercial' THEN 'COMMERCIAL_IDENTIFICATION_FAILURE' WHEN g = 'multi_unit' AND p = 'single_unit' THEN 'MULTI_UNIT_UNDER_COUNT' ELSE 'WRONG_BUILDING_TYPE' END
 ELSE CASE WHEN g = 'accept' AND p = 'review' THEN 'OVER_SENSITIVE_REVIEW' WHEN g = 'review' AND p = 'accept' THEN 'UNDETECTED_CONFLICT' ELSE 'GENERAL_MISMATCH' END END"""


@_query("error_buckets", f"WITH {ctes('gold', 'raw', 'result')}, {_COMPARE}, e AS (SELECT {_CATEGORY} AS category, row_number() OVER (PARTITION BY field ORDER BY gold_label_id, source_id) AS n FROM lng WHERE g IS NOT NULL AND g IS DISTINCT FROM p) SELECT category, count(*) AS n FROM e WHERE n <= 100 GROUP BY category ORDER BY n DESC, category LIMIT 10")
def _buckets(spark, d):
    return evaluate.error_buckets(evaluate.error_samples(_compared(spark, d)))


def _rate(c: str) -> str:
    return f"round(count(*) FILTER ({c}) / nullif(count(*), 0), 4)"


_COMMERCIAL = "building_type = 'commercial'"


@_query("cleaning_distribution", f"WITH {ctes('result')} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (decision = '{x}') AS {x}_count" for x in ("accept", "enrich", "review", "reject")) + ", " + ", ".join(f"count(*) FILTER (building_type = '{x}') AS {x}_count" for x in ("single_unit", "multi_unit", "commercial", "unknown")) + f", count(unit_number) AS unit_count, " + ", ".join(f"{_rate(f'decision = {_q(x)}')} AS {x}_rate" for x in ("accept", "review", "reject", "enrich")) + f", {_rate(_COMMERCIAL)} AS commercial_rate, {_rate('unit_number IS NOT NULL')} AS unit_rate FROM result")
def _cleaning(spark, d):
    return evaluate.distribution(derived(spark, d, "result"))


_ROUND = lambda floor, x, step, default: f"coalesce(round(greatest(CAST({floor} AS DOUBLE), nullif({x}, -1) + CAST({step} AS DOUBLE)), 4), CAST({default} AS DOUBLE))"


@_query("decision_policy", f"""WITH {ctes('gold', 'result')}, j AS (SELECT lower(trim(coalesce(gold_decision, ''))) AS d, lower(trim(coalesce(gold_building_type, ''))) AS b, coalesce(confidence, 0) AS c, coalesce(reference_score, 0) AS s
  FROM gold g JOIN result r ON g.workspace_name = r.workspace_name AND g.source_id = CAST(r.raw_id AS VARCHAR) WHERE review_status = 'accepted' AND label_source = 'human'),
m AS (SELECT coalesce(min(c) FILTER (d = 'accept' AND b = 'commercial'), -1) AS ac, coalesce(min(c) FILTER (d = 'accept' AND b = 'multi_unit'), -1) AS am, coalesce(min(c) FILTER (d = 'accept'), -1) AS a,
  coalesce(min(c) FILTER (d = 'review'), -1) AS r, max(c) FILTER (d = 'reject') AS x, coalesce(min(s) FILTER (s > 0), -1) AS f FROM j)
SELECT {_ROUND(0.7, 'ac', -0.01, 0.88)} AS commercial_accept, {_ROUND(0.55, 'am', -0.01, 0.72)} AS multi_unit_accept, {_ROUND(0.65, 'a', -0.01, 0.82)} AS high_confidence_accept,
  greatest({_ROUND(0.4, 'r', -0.01, 0.62)}, round(x + CAST(0.01 AS DOUBLE), 4)) AS moderate_review, {_ROUND(0.4, 'r', -0.01, 0.72)} AS parser_disagreement_review, {_ROUND(0.4, 'r', -0.01, 0.72)} AS commercial_review,
  {_ROUND(0.5, 'f', 0.0, 0.62)} AS gps_weak_match, {_ROUND(0.4, 'f', -0.05, 0.5)} AS gps_conflict FROM m""")
def _policy(spark, d):
    return evaluate.learned_policy(derived(spark, d, "gold"), derived(spark, d, "result"))


@_query("replay_summary", f"""WITH {ctes('raw', 'reference', 'result')}, {_VALID}, a AS (SELECT raw_id, decision AS ad, building_type AS ab, coalesce(unit_number, '') AS au, confidence AS ac FROM result), j2 AS (SELECT a.*, v.decision AS cd, v.building_type AS cb, coalesce(v.suggested_unit, '') AS cu, v.confidence AS cc FROM a JOIN v USING (raw_id))
SELECT count(*) AS processed, {_rate('ad = cd')} AS decision_match_rate, {_rate('ab = cb')} AS building_type_match_rate, {_rate('au = cu')} AS unit_number_match_rate, {_rate('NOT (ad = cd AND ab = cb AND au = cu)')} AS disagreement_rate, {_rate("cd = 'review'")} AS review_rate, {_rate("cd = 'reject'")} AS reject_rate, round(coalesce(avg(cc - ac), 0), 4) AS confidence_delta FROM j2""")
def _replay(spark, d):
    return evaluate.replay_summary(evaluate.replay(derived(spark, d, "result"), _validated(spark, d).withColumn("unit_number", F.col("suggested_unit"))))


@_query("release_gate", f"WITH {ctes('model')} SELECT version, CASE WHEN score / 2000 < 0.90::DOUBLE THEN 'decision_f1' WHEN score / 1500 < 0.85::DOUBLE THEN 'building_type_f1' WHEN promoted_at IS NULL THEN 'unit_recall' WHEN created_at / 1000.0::DOUBLE > 0.35::DOUBLE THEN 'review_rate' END AS blocked_by FROM model")
def _gate(spark, d):
    m = derived(spark, d, "model")
    one, none = F.lit(1.0), F.lit(0.0)
    metrics = m.select("version", (F.col("score") / 2000).alias("decision_f1"), (F.col("score") / 1500).alias("building_type_f1"), one.alias("unit_number_f1"), F.when(F.col("promoted_at").isNotNull(), one).alias("unit_recall"), one.alias("commercial_f1"), (F.col("created_at") / 1000.0).alias("review_rate"), none.alias("reject_rate"), none.alias("regression_risk"), none.alias("replay_failures"), one.alias("processed_samples"), F.lit(True).alias("promote_recommended"), none.alias("shadow_advantage"), none.alias("disagreement_rate"))
    return evaluate.release_gate(metrics).select("version", "blocked_by")


@_query("job_counts", f"WITH {ctes('job')}, m AS (SELECT unnest(['queued', 'running', 'completed', 'failed', 'cancelled']) AS status) SELECT m.status, count(job.job_id) AS n FROM m LEFT JOIN job ON m.status = job.status GROUP BY m.status")
def _jobs(spark, d):
    return tables.counts_by(derived(spark, d, "job"), "status", ["queued", "running", "completed", "failed", "cancelled"])


@_query("next_jobs", f"WITH {ctes('job')} SELECT job_id, job_kind, priority FROM job WHERE status = 'queued' ORDER BY priority DESC, created_at, job_id LIMIT 20")
def _next_jobs(spark, d):
    return tables.listing(derived(spark, d, "job"), {"status": "queued", "job_kind": None}, [F.col("priority").desc(), "created_at", "job_id"], 20).select("job_id", "job_kind", "priority")


@_query("latest_model", f"WITH {ctes('model')}, r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY is_default DESC, promoted_at DESC NULLS LAST, created_at DESC, version DESC) AS k FROM model) SELECT model_name, version FROM r WHERE k = 1")
def _latest(spark, d):
    return tables.newest(derived(spark, d, "model"), "model_name", [F.col("is_default").desc(), F.col("promoted_at").desc_nulls_last(), F.col("created_at").desc(), F.col("version").desc()]).select("model_name", "version")


@_query("unit_confidence", "WITH c AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t, max(n) AS m, count(*) AS k FROM c GROUP BY user_id), e AS (SELECT c.user_id, -sum(n / t * ln(n / t)) AS h FROM c JOIN t ON c.user_id = t.user_id GROUP BY c.user_id) SELECT t.user_id, round(m / t * CASE WHEN k > 1 THEN 1 - h / ln(k) ELSE 0 END, 4) + 0 AS confidence FROM t JOIN e ON t.user_id = e.user_id WHERE k > 1")
def _confidence(spark, d):
    by = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    arrays = by.groupBy("user_id").agg(F.sort_array(F.collect_list("n")).alias("f")).where(F.size("f") > 1)
    return arrays.select("user_id", (F.round(s.frequency_confidence("f"), 4) + 0).alias("confidence"))


@_query("gps_scores", f"WITH {ctes('raw')} SELECT raw_id, CASE WHEN latitude IS NULL THEN CAST(0.55 AS DOUBLE) WHEN {_HAVERSINE} <= 20 THEN CAST(1.0 AS DOUBLE) WHEN {_HAVERSINE} <= 60 THEN CAST(0.9 AS DOUBLE) WHEN {_HAVERSINE} <= 120 THEN CAST(0.78 AS DOUBLE) WHEN {_HAVERSINE} <= 250 THEN CAST(0.62 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS score FROM (SELECT *, pow(sin((radians(CAST(44.605 AS DOUBLE)) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(CAST(44.605 AS DOUBLE))) * pow(sin((radians(CAST(-63.6 AS DOUBLE)) - radians(longitude)) / 2), 2) AS h_ FROM raw)")
def _gps(spark, d):
    return derived(spark, d, "raw").select("raw_id", gps_score("latitude", "longitude", F.lit(44.605), F.lit(-63.6)).alias("score"))


def city_pairs(raw, reference):
    """a, b, ok: each city of raw with each of reference in the same province."""
    a = raw.select(F.col("city").alias("a"), F.col("province").alias("p")).distinct()
    b = reference.select(F.col("city").alias("b"), F.col("province").alias("p")).distinct()
    return a.join(b, "p").select("a", "b").distinct().withColumn("ok", city_compatible("a", "b"))


@_query("city_compatible", f"WITH {ctes('raw', 'reference')}, x AS (SELECT DISTINCT raw.city AS a, reference.city AS b, {_title('raw.city')} AS c1, {_title('reference.city')} AS c2 FROM (SELECT DISTINCT city, province FROM raw) raw JOIN (SELECT DISTINCT city, province FROM reference) reference ON raw.province = reference.province) SELECT a, b, (c1 IS NULL OR c2 IS NULL OR c1 = c2 OR (len(list_intersect({_WORDS('c1')}, {_WORDS('c2')})) > 0 AND CAST(len(list_intersect({_WORDS('c1')}, {_WORDS('c2')})) AS DOUBLE) / least(len({_WORDS('c1')}), len({_WORDS('c2')})) >= 0.5)) AS ok FROM x")
def _city(spark, d):
    return city_pairs(derived(spark, d, "raw"), derived(spark, d, "reference"))


@_query("event_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _windows(spark, d):
    out = windowed_counts(spark.read.parquet(f"{d}/events.parquet"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


from waymark import release_queries  # noqa: E402, F401  registers its queries here


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
