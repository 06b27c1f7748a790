"""Authoritative reference points: import and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import scalars as s
from waymark.operators.parsers import once

# Weights, acceptance and the distance ladder in meters.
LOCALITY, GPS, QUALITY = 0.45, 0.30, 0.25
ACCEPT_ONE, ACCEPT_MANY = 0.70, 0.78
LADDER = ((20, 1.0), (60, 0.9), (120, 0.78), (250, 0.62))
FAR, NO_OBSERVATION = 0.25, 0.55
BOUNDS = ((43.0, 47.5), (-67.5, -58.0))


def city_words(title: Column) -> Column:
    return F.array_distinct(F.split(F.upper(title), " "))


def same_city(a: Column, b: Column, words_a: Column, words_b: Column) -> Column:
    """As city_compatible, of names in title case and their words."""
    shared = F.size(F.array_intersect(words_a, words_b))
    enough = (shared > 0) & (shared.cast("double") / F.least(F.size(words_a), F.size(words_b)) >= 0.5)
    return F.when(a.isNull() | b.isNull() | (a == b), True).otherwise(enough)


def city_compatible(left, right) -> Column:
    """True if either is empty, both are equal, or half the shorter one's words are shared."""
    a, b = s.city_name(left), s.city_name(right)
    return same_city(a, b, city_words(a), city_words(b))


def gps_score(lat, lon, ref_lat, ref_lon) -> Column:
    return near_score(lat, lon, ref_lat, ref_lon, s.haversine_meters(lat, lon, ref_lat, ref_lon))


def near_score(lat, lon, ref_lat, ref_lon, meters: Column) -> Column:
    """The score of a distance; without an observation or a reference point a fixed one."""
    has_ref = s.col(ref_lat).isNotNull() & s.col(ref_lon).isNotNull()
    near = F.when(~(has_ref & s.col(lat).isNotNull() & s.col(lon).isNotNull()), F.when(has_ref, NO_OBSERVATION).otherwise(FAR))
    for bound, value in LADDER:
        near = near.when(meters <= bound, value)
    return near.otherwise(FAR)


def gathered(references: DataFrame, localities: tuple[str, ...] = ("city",)) -> DataFrame:
    """A row for each address of the active references (__w, __n, __s, __p): __refs (an entry for each place, with the reference that wins there), __k (how many references), __u (their units in order)."""
    key = ["__w", "__n", "__s", "__p"]
    locality = F.coalesce(*[s.filled(F.trim(c)) for c in localities if c in references.columns])
    r = references.where("is_active").select(
        F.col("workspace_name").alias("__w"), F.upper("street_number").alias("__n"), F.upper("street_name").alias("__s"), F.upper("province").alias("__p"), "reference_id", F.col("external_id").alias("ext"),
        s.city_name(locality).alias("city"), F.col("reference_lat").alias("lat"), F.col("reference_lon").alias("lon"), F.coalesce("quality_score", F.lit(0.0)).alias("quality"), s.filled(F.upper(F.trim("unit_number"))).alias("unit"),
    ).na.drop(subset=key)
    place = ["city", "lat", "lon", "quality"]
    r = r.groupBy(*key, *place).agg(F.max(F.struct((-F.col("reference_id")).alias("order"), F.col("reference_id").alias("id"), "ext")).alias("first"), F.count(F.lit(1)).alias("n"), F.collect_set("unit").alias("units"))
    refs = F.collect_list(F.struct(*place, city_words(F.col("city")).alias("words"), "first"))
    return r.groupBy(*key).agg(refs.alias("__refs"), F.sum("n").alias("__k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("units")))).alias("__u"))


def match_reference(df: DataFrame, references: DataFrame, localities: tuple[str, ...] = ("city",), observed: tuple[str, ...] = ("city",)) -> DataFrame:
    """df (workspace_name, street_number, street_name, province, city, latitude, longitude) with the best reference.

    Adds reference_id, reference_external_id, reference_score, reference_candidates, reference_units. The
    references of an address (workspace, number, street and province: its units and entrances) are gathered
    first, with their cities prepared; one left join brings them to the rows, which are read once and keep
    their number, and each row ranks its candidates by itself. References of an address in one city, at one point
    and of one quality score alike, so the one that wins among them stands for all: a row ranks an address's
    places, however many references they have. Of equal scores the least reference_id wins, and score 0 never
    does. localities: the reference columns of which the first filled one is its locality. observed: the columns
    of df that name a locality; one that fits is enough, and without any all fit.
    """
    points = gathered(references, localities)
    names = F.array_distinct(F.array_compact(F.array(*[s.city_name(c) for c in observed if c in df.columns])))
    if observed == ("city",):
        rows = once(df, {"__ca": s.city_name("city")}).withColumn("__wa", city_words(F.col("__ca")))
    else:
        rows = once(df, {"__seen": F.transform(names, lambda c: F.struct(c.alias("name"), city_words(c).alias("words")))})

    def fits(x: Column) -> Column:
        if observed == ("city",):
            return same_city(F.col("__ca"), x["city"], F.col("__wa"), x["words"])
        return (F.size("__seen") == 0) | F.exists("__seen", lambda o: F.coalesce(same_city(o["name"], x["city"], o["words"], x["words"]), F.lit(False)))

    on = (F.col("workspace_name") == F.col("__w")) & (F.upper("street_number") == F.col("__n")) & (F.upper("street_name") == F.col("__s")) & (F.upper("province") == F.col("__p"))

    def scored(x: Column) -> Column:
        value = F.lit(LOCALITY) * F.when(fits(x), 1.0).otherwise(0.0)
        value = value + F.lit(GPS) * near_score("latitude", "longitude", x["lat"], x["lon"], x["meters"]) + F.lit(QUALITY) * x["quality"]
        return F.struct(F.round(value, 4).alias("score"), x["first"].alias("first"))

    measured = F.transform("__refs", lambda x: F.struct(*[x[c].alias(c) for c in ("first", "city", "words", "lat", "lon", "quality")], s.haversine_meters("latitude", "longitude", x["lat"], x["lon"]).alias("meters")))
    out = once(rows.join(points, on, "left"), {"__m": F.array_max(F.transform(measured, scored)), "__k": F.col("__k"), "__u": F.col("__u")})
    ok = (F.col("__m.score") > 0) & (F.col("__m.score") >= F.when(F.col("__k") == 1, ACCEPT_ONE).otherwise(ACCEPT_MANY))
    found = {"reference_id": F.col("__m.first.id"), "reference_external_id": F.col("__m.first.ext"), "reference_score": F.col("__m.score"), "reference_candidates": F.col("__k"), "reference_units": F.col("__u")}
    return out.select(*[F.col(c) for c in df.columns], *[F.when(ok, v).alias(c) for c, v in found.items()])


def civic_points(df: DataFrame, workspace: str = "default", source: str = "civic") -> DataFrame:
    """Reference rows from a civic-point table (all strings): names, bounds and quality as imported."""
    have = set(df.columns)
    c = lambda name: F.trim(F.col(name)) if name in have else F.lit(None).cast("string")
    lat, lon = c("LAT").try_cast("double"), c("LONG").try_cast("double")
    inside = F.coalesce(lat.between(*BOUNDS[0]) & lon.between(*BOUNDS[1]), F.lit(False))
    name = F.concat_ws(" ", *[s.filled(c(x)) for x in ("STRPREFIX", "STRNAME", "STRSUFFIX", "STRDIR")])
    out = df.select(
        F.lit(workspace).alias("workspace_name"), F.lit(source).alias("source_name"), s.first_filled(c("PNTID"), c("ADD_LOC")).alias("external_id"),
        F.upper(s.filled(c("CIVICNUM"))).alias("street_number"), s.street(name).alias("street_name"), s.reference_unit(c("UNIT_NUM")).alias("unit_number"),
        F.coalesce(s.filled(c("COMM")), s.filled(c("MUN")), F.lit("Halifax")).alias("city"), s.filled(c("COUNTY")).alias("county"), F.lit("NS").alias("province"),
        F.when(inside, lat).alias("reference_lat"), F.when(inside, lon).alias("reference_lon"), F.lit("authoritative").alias("reference_tier"),
        F.when(inside, 0.95).otherwise(0.82).alias("quality_score"), F.to_json(F.struct("*")).alias("raw_payload"), F.lit(True).alias("is_active"),
    )
    return out.where("street_number IS NOT NULL AND street_name IS NOT NULL AND external_id IS NOT NULL")
