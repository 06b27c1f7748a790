"""Trained models on raw rows: artifacts, and several models over one parse and one reference join.

A model is a profile, a choice of parsers, a decision policy and parser weights. Rows are parsed once for each
profile; an array of the models, a literal, is then exploded, so each row meets each model, which scores and ranks
the candidates by its own weights and parsers. The plan has the same size for any number of models.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import scalars as s
from waymark.operators.candidates import DEFAULT_PARSERS, parsed, score
from waymark.operators.decision import DecisionPolicy, decided
from waymark.operators.evaluate import BENCHMARK_FIELDS, benchmark_rows, parser_weights, rate
from waymark.operators.parsers import PARSERS, once, profile_of

# Names of a policy's thresholds in an artifact.
THRESHOLDS = {
    "close_candidate_delta": "close_candidate_delta",
    "commercial_accept_threshold": "commercial_accept",
    "multi_unit_accept_threshold": "multi_unit_accept",
    "parser_disagreement_review_threshold": "parser_disagreement_review",
    "commercial_review_threshold": "commercial_review",
    "high_confidence_accept_threshold": "high_confidence_accept",
    "moderate_confidence_review_threshold": "moderate_review",
    "gps_weak_match_threshold": "gps_weak_match",
    "gps_conflict_threshold": "gps_conflict",
}
_NUMBERS = tuple(f.name for f in fields(DecisionPolicy) if f.name != "parser_weights")


@dataclass(frozen=True)
class Model:
    name: str
    version: str = "1"
    profile: str | None = None
    parsers: tuple[str, ...] = DEFAULT_PARSERS
    policy: DecisionPolicy = field(default_factory=DecisionPolicy)


def _number(value) -> float | None:
    if isinstance(value, bool):
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def model_of(artifact: dict, name: str, version: str = "1", default_profile: str | None = None) -> Model:
    """A model from a decoded artifact: profile, parsers and decision_policy with its thresholds and parser_weights; what is missing or no number has its default."""
    policy = artifact.get("decision_policy")
    policy = policy if isinstance(policy, dict) else {}
    weights = policy.get("parser_weights")
    weights = {k: v for k, w in (weights if isinstance(weights, dict) else {}).items() if (v := _number(w)) is not None}
    numbers = {own: v for theirs, own in THRESHOLDS.items() if (v := _number(policy.get(theirs))) is not None}
    names = artifact.get("parsers")
    names = tuple(str(p) for p in names if str(p).strip()) if isinstance(names, list) and names else DEFAULT_PARSERS
    profile = artifact.get("profile")
    profile = profile.strip() if isinstance(profile, str) and profile.strip() else default_profile
    return Model(name, version, profile, names, DecisionPolicy(**numbers, parser_weights=weights))


def artifact_of(model: Model) -> dict:
    """The artifact of a model, as model_of() reads it."""
    policy = {theirs: getattr(model.policy, own) for theirs, own in THRESHOLDS.items()}
    return {"profile": model.profile, "parsers": list(model.parsers), "decision_policy": policy | {"parser_weights": dict(model.policy.parser_weights)}}


def read_artifact(spark: SparkSession, path: str | None) -> dict:
    """A decoded artifact; {} without a path, a file or an object in it."""
    if not path:
        return {}
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    try:
        body = json.loads(text)
    except ValueError:
        return {}
    return body if isinstance(body, dict) else {}


def write_artifact(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(json.dumps(artifact_of(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def registered_model(spark: SparkSession, registry: DataFrame, workspace: str, version: str | None = None) -> Model:
    """A registry's model of a workspace: that version's default or newest row, without a version the active (default) one; an error if there is none.

    registry: workspace_name, model_name, model_version, is_default, default_profile, artifact_path, updated_at.
    """
    rows = registry.where(F.col("workspace_name") == workspace)
    rows = rows.where("is_default") if version is None else rows.where(F.col("model_version") == version)
    row = rows.orderBy(F.col("is_default").desc_nulls_last(), F.col("updated_at").desc_nulls_last()).first()
    if row is None:
        raise ValueError(f"no model {version or '(active)'} in workspace {workspace}")
    return model_of(read_artifact(spark, row["artifact_path"]), row["model_name"], row["model_version"], row["default_profile"])


def _literal(m: Model, weights: dict[str, float]) -> Column:
    none = F.create_map().cast("map<string,double>")
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
    numbers = [F.lit(float(getattr(m.policy, n))).alias(n) for n in _NUMBERS]
    return F.struct(F.lit(m.name).alias("name"), F.array(*[F.lit(p) for p in m.parsers]).alias("parsers"), (F.create_map(*pairs) if pairs else none).alias("weights"), *numbers)


class _Thresholds:
    """A policy whose thresholds are columns of the row's model."""

    def __init__(self):
        for n in _NUMBERS:
            setattr(self, n, F.col("__model")[n])


def _chosen(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (cand_<parser>, __model) with best, parser_disagreement and alternate_units by the model's parsers and weights."""

    def entry(name: str) -> Column:
        c = F.col(f"cand_{name}")
        value = score(c["parsed"], F.coalesce(F.col("__model")["weights"][name], F.lit(0.0)))
        cand = F.struct(value.alias("score"), *[c[x].alias(x) for x in ("parser_name", "parser_version", "parsed", "match_rules")])
        place = F.array_position(F.col("__model")["parsers"], name)
        return F.when(place > 0, F.struct((-value).alias("k"), place.alias("o"), cand.alias("c")))

    rows = once(rows, {"__ranked": F.array_sort(F.array_compact(F.array(*[entry(n) for n in names])))}).drop(*[f"cand_{n}" for n in names])
    best = F.get("__ranked", F.lit(0))["c"]
    floor = F.greatest(best["score"] - F.col("__model")["close_candidate_delta"], F.lit(0.0))
    place = lambda x: F.struct(*[F.coalesce(x["c"]["parsed"][f], F.lit("")).alias(f) for f in ("street_number", "street_name", "unit_number")])
    close = F.transform(F.filter("__ranked", lambda x: x["c"]["score"] >= floor), place)
    units = F.filter(F.transform(close, lambda t: t["unit_number"]), lambda u: (u != "") & (u != F.coalesce(best["parsed"]["unit_number"], F.lit(""))))
    rows = once(rows, {"best": best, "parser_disagreement": F.size(F.array_distinct(close)) >= 2, "alternate_units": F.slice(units, 1, 3)})
    return rows.drop("__ranked").where("best IS NOT NULL")


def validate_models(df: DataFrame, references: DataFrame, models: list[Model], reranker: Model | None = None) -> DataFrame:
    """validate() of every row by every model: a row for each, with column model. One parse and one reference join for each profile.

    reranker: a model whose parser weights go over each model's own, as an active model's do. Unknown parsers are
    skipped; a model without a known one is an error, and so are two models of one name.
    """
    if len({m.name for m in models}) < len(models):
        raise ValueError("two models have one name")
    for m in models:
        if not set(m.parsers) & set(PARSERS):
            raise ValueError(f"model {m.name} has no known parser")
    over = dict(reranker.policy.parser_weights) if reranker else {}
    outs = []
    for profile in dict.fromkeys(m.profile for m in models):
        own = [m for m in models if m.profile == profile]
        names = [p for p in PARSERS if any(p in m.parsers for m in own)]
        rows = parsed(df, profile_of(profile), tuple(names)).drop("best")
        each = F.array(*[_literal(m, {**m.policy.parser_weights, **over}) for m in own])
        chosen = _chosen(rows.withColumn("__model", F.explode(each)), names)
        outs.append(decided(chosen, references, _Thresholds(), profile_of(profile), ("__model",)))
    out = reduce(DataFrame.unionByName, outs)
    return out.withColumn("model", F.col("__model")["name"]).drop("__model")


def said(validated: DataFrame, model: str) -> DataFrame:
    """What one model says: workspace_name, raw_id, decision, building_type, unit_number (the suggested one), confidence."""
    return validated.where(F.col("model") == model).select("workspace_name", "raw_id", "decision", "building_type", F.col("suggested_unit").alias("unit_number"), "confidence")


def side_by_side(rows: DataFrame, validated: DataFrame, names: dict[str, str], columns: tuple[str, ...] = ("decision", "building_type", "unit_number", "confidence")) -> DataFrame:
    """rows with <prefix>_<column> and <prefix>_there of each model, in one aggregation instead of a join for each; names: prefix to model."""
    v = validated.withColumn("unit_number", F.col("suggested_unit"))
    picked = [F.max(F.when(F.col("model") == m, F.struct(F.lit(True).alias("there"), *columns))).alias(f"__{p}") for p, m in names.items()]
    wide = v.groupBy("workspace_name", "raw_id").agg(*picked)
    flat = [F.col(f"__{p}")[c].alias(f"{p}_{c}") for p in names for c in ("there", *columns)]
    return rows.join(wide.select("workspace_name", "raw_id", *flat), ["workspace_name", "raw_id"], "left")


def parsers_alone(cases: DataFrame, rows: DataFrame, references: DataFrame, parsers: tuple[str, ...] = DEFAULT_PARSERS, profile: str | None = None, policy: DecisionPolicy | None = None) -> DataFrame:
    """parser_name, field, total, matched, accuracy of each parser alone on golden cases, from one parse.

    cases: case_id, expected; rows: the cases as raw rows whose raw_id is the case_id. The fields of the place are the best candidate's, building type and decision the validation's.
    """
    models = [Model(p, profile=profile, parsers=(p,), policy=policy or DecisionPolicy()) for p in parsers]
    results = validate_models(rows, references, models).select(F.col("model").alias("parser_name"), F.col("raw_id").alias("case_id"), *BENCHMARK_FIELDS)
    each = cases.select("expected", F.col("case_id").alias("__case"), F.explode(F.array(*[F.lit(p) for p in parsers])).alias("__parser"))
    key = lambda c, p: F.to_json(F.struct(F.col(c).alias("c"), F.col(p).alias("p")))
    found = benchmark_rows(each.select(key("__case", "__parser").alias("case_id"), "expected"), results.withColumn("case_id", key("case_id", "parser_name")))
    counted = found.groupBy(s.dig("case_id", "p").alias("parser_name"), "field").agg(F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"))
    return counted.withColumn("accuracy", rate(F.col("matched"), F.col("total")))


def learned_weights(cases: DataFrame, rows: DataFrame, references: DataFrame, parsers: tuple[str, ...] = DEFAULT_PARSERS, profile: str | None = None, policy: DecisionPolicy | None = None) -> DataFrame:
    """parser_name, score, weight of each parser by its accuracies alone (see evaluate.parser_weights)."""
    alone = parsers_alone(cases, rows, references, parsers, profile, policy).select("parser_name", "field", "accuracy")
    every = cases.sparkSession.createDataFrame([(p, "", 0.0) for p in parsers], "parser_name string, field string, accuracy double")
    return parser_weights(alone.unionByName(every))
