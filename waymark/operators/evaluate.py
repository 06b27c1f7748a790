"""Comparison of predictions with gold labels, metrics, error buckets, policies, replay and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import scalars as s

FIELDS = ("decision", "building_type", "unit_number")
BENCHMARK_FIELDS = ("street_number", "street_name", "unit_number", "building_type", "decision")


def gold_compare(gold: DataFrame, raw: DataFrame, results: DataFrame) -> DataFrame:
    """Accepted human labels with the raw record that their source_id names (as raw_id or as external_id) and its result.

    The or in the join would compare all with all; raw records are listed under both keys instead.
    """
    g = gold.where((F.col("review_status") == "accepted") & (F.col("label_source") == "human"))
    keyed = raw.select("workspace_name", "raw_id", "raw_address_text", F.explode(F.array_distinct(F.array(F.col("raw_id").cast("string"), F.col("external_id")))).alias("source_id")).where("source_id IS NOT NULL")
    keyed = keyed.dropDuplicates(["workspace_name", "source_id", "raw_id"])
    out = g.join(keyed, ["workspace_name", "source_id"], "left")
    return out.join(results.select("workspace_name", "raw_id", *[F.col(c).alias(f"pred_{c}") for c in FIELDS], "confidence", "unit_source"), ["workspace_name", "raw_id"], "left")


def gold_value(field: str, c) -> Column:
    v = s.filled(F.trim(s.col(c)))
    if field == "decision":
        return F.when(F.lower(v) == "correct", "accept").otherwise(v)
    return s.unit_number(v) if field == "unit_number" else v


def rate(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 4)


def _f1(p: Column, r: Column) -> Column:
    return F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4)


def field_metrics(compared: DataFrame) -> DataFrame:
    """field, total, skipped, tp, fp, fn, accuracy, precision, recall, f1; compared has gold_<field> and pred_<field>. One pass."""
    long = compared.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), gold_value(f, f"gold_{f}").alias("g"), gold_value(f, f"pred_{f}").alias("p")) for f in FIELDS])).alias("x")).select("x.*")
    counted = long.groupBy("field").agg(
        F.count_if(F.col("g").isNotNull()).alias("total"), F.count_if(F.col("g").isNull()).alias("skipped"), F.count_if(F.col("g") == F.col("p")).alias("tp"),
        F.count_if((F.col("g") != F.col("p"))).alias("fp"), F.count_if(F.col("g").isNotNull() & ~F.col("g").eqNullSafe(F.col("p"))).alias("fn"),
    )
    return _rates(counted)


def _rates(counted: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counted.withColumns({"accuracy": rate(tp, F.col("total")), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn)})
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def label_metrics(compared: DataFrame, field: str, label: str) -> DataFrame:
    """The same for one label against all others, with tn."""
    g, p = gold_value(field, f"gold_{field}") == label, F.coalesce(gold_value(field, f"pred_{field}") == label, F.lit(False))
    rows = compared.where(gold_value(field, f"gold_{field}").isNotNull())
    counted = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    out = counted.withColumns({"accuracy": rate(F.col("tp") + F.col("tn"), F.col("total")), "precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def error_samples(compared: DataFrame, per_field: int = 100) -> DataFrame:
    """The first wrong predictions of each field in the order of gold_label_id, with their category."""
    parts = []
    for f in FIELDS:
        g, p = gold_value(f, f"gold_{f}"), gold_value(f, f"pred_{f}")
        wrong = compared.where(g.isNotNull() & ~g.eqNullSafe(p))
        parts.append(wrong.select("gold_label_id", "source_id", F.lit(f).alias("field"), g.alias("gold"), p.alias("predicted"), "confidence", s.error_category(f, g, p, "unit_source", "raw_address_text").alias("category")))
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("gold_label_id", "source_id"))).where(F.col("n") <= per_field)


def error_buckets(samples: DataFrame, top: int = 10) -> DataFrame:
    return samples.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category").limit(top)


def distribution(results: DataFrame) -> DataFrame:
    """Counts by decision and building type and six rates, in one pass."""
    d, b = F.lower(F.trim("decision")), F.lower(F.trim("building_type"))
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(d == x).alias(f"{x}_count") for x in ("accept", "enrich", "review", "reject")]
    aggs += [F.count_if(b == x).alias(f"{x}_count") for x in ("single_unit", "multi_unit", "commercial", "unknown")]
    aggs.append(F.count_if(s.filled(F.trim("unit_number")).isNotNull()).alias("unit_count"))
    out = results.agg(*aggs)
    return out.withColumns({f"{n}_rate": rate(F.col(f"{n}_count"), F.col("total")) for n in ("accept", "review", "reject", "enrich", "commercial", "unit")})


def coverage(n: Column, total: Column) -> Column:
    return F.round(F.least(F.lit(0.99), F.when(total > 0, n / total).otherwise(0.0)), 4)


def learned_policy(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Thresholds from accepted human labels joined with results: each keeps its default where no row tells it.

    The label's own decision and building type count, as they stand (a decision "correct" is no accept); a missing confidence counts as 0.
    """
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    g = gold.where((F.col("review_status") == "accepted") & (F.col("label_source") == "human")).select("workspace_name", "source_id", text("gold_decision").alias("d"), text("gold_building_type").alias("b"))
    r = results.select("workspace_name", F.col("raw_id").cast("string").alias("source_id"), F.coalesce("confidence", F.lit(0.0)).alias("c"), F.coalesce("reference_score", F.lit(0.0)).alias("s"))
    c, d, b, at = F.col("c"), F.col("d"), F.col("b"), F.col("s")
    m = g.join(r, ["workspace_name", "source_id"]).agg(
        F.min(F.when((d == "accept") & (b == "commercial"), c)).alias("ac"), F.min(F.when((d == "accept") & (b == "multi_unit"), c)).alias("am"), F.min(F.when(d == "accept", c)).alias("a"),
        F.min(F.when(d == "review", c)).alias("r"), F.max(F.when(d == "reject", c)).alias("x"), F.min(F.when(at > 0, at)).alias("ref"),
    )
    low = lambda floor, name, step, default: F.coalesce(F.round(F.when(F.col(name).isNotNull(), F.greatest(F.lit(floor), F.col(name) + step)), 4), F.lit(default))
    out = m.select(
        "x", low(0.7, "ac", -0.01, 0.88).alias("commercial_accept"), low(0.55, "am", -0.01, 0.72).alias("multi_unit_accept"), low(0.65, "a", -0.01, 0.82).alias("high_confidence_accept"),
        low(0.4, "r", -0.01, 0.62).alias("moderate_review"), low(0.4, "r", -0.01, 0.72).alias("parser_disagreement_review"), low(0.4, "r", -0.01, 0.72).alias("commercial_review"),
        low(0.5, "ref", 0.0, 0.62).alias("gps_weak_match"), low(0.4, "ref", -0.05, 0.5).alias("gps_conflict"),
    )
    above = F.round(F.col("x") + 0.01, 4)
    return out.withColumn("moderate_review", F.greatest(F.col("moderate_review"), F.coalesce(above, F.col("moderate_review")))).drop("x")


def parser_weights(accuracies: DataFrame) -> DataFrame:
    """parser_name, score (mean of its five benchmark accuracies), weight (of sum 1; uniform if no score is over 0).

    accuracies: parser_name, field, accuracy, as benchmark_report() gives them for each parser alone; a
    field without cases counts as 0.
    """
    by = accuracies.groupBy("parser_name").agg(F.round(F.sum("accuracy") / len(BENCHMARK_FIELDS), 4).alias("score"))
    every = Window.partitionBy()  # a row for each parser
    total, n = F.sum("score").over(every), F.count(F.lit(1)).over(every)
    return by.withColumn("weight", F.round(F.when(total > 0, F.col("score") / total).otherwise(1 / n), 4))


def reranking_weights(features: DataFrame) -> DataFrame:
    """Precision for each parser source: the parser's name, else the rule that found the unit."""
    return features.groupBy("unit_source").agg(F.round(F.avg(F.col("target_is_correct").cast("double")), 4).alias("precision"), F.count(F.lit(1)).alias("n"))


def replay(active: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both models' results of the same rows (workspace_name, raw_id, decision, building_type, unit_number (the suggested one), confidence) with match flags; null and '' are equal."""
    a = active.select("workspace_name", "raw_id", *[F.col(c).alias(f"a_{c}") for c in (*FIELDS, "confidence")])
    b = candidate.select("workspace_name", "raw_id", *[F.col(c).alias(f"c_{c}") for c in (*FIELDS, "confidence")])
    j = a.join(b, ["workspace_name", "raw_id"])
    same = {f"{f}_match": F.coalesce(F.col(f"a_{f}"), F.lit("")) == F.coalesce(F.col(f"c_{f}"), F.lit("")) for f in FIELDS}
    return j.withColumns(same).withColumn("different", ~(F.col("decision_match") & F.col("building_type_match") & F.col("unit_number_match")))


def replay_summary(replayed: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 4)
    return replayed.agg(
        F.count(F.lit(1)).alias("processed"), *[share(F.col(f"{f}_match")).alias(f"{f}_match_rate") for f in FIELDS], share(F.col("different")).alias("disagreement_rate"),
        share(F.col("c_decision") == "review").alias("review_rate"), share(F.col("c_decision") == "reject").alias("reject_rate"),
        F.round(F.coalesce(F.avg(F.col("c_confidence") - F.col("a_confidence")), F.lit(0.0)), 4).alias("confidence_delta"),
    )


# Gates of a release (metric, bound, whether it is a minimum).
GATES = (("decision_f1", 0.90, True), ("building_type_f1", 0.85, True), ("unit_number_f1", 0.85, True), ("unit_recall", 0.85, True), ("commercial_f1", 0.85, True), ("review_rate", 0.35, False), ("reject_rate", 0.10, False), ("regression_risk", 0.02, False))

#: Further gates of replay and shadow run, in the same form; promote_recommended is a boolean.
RUN_GATES = (("replay_failures", 0, False), ("processed_samples", 1, True), ("promote_recommended", 1, True), ("shadow_advantage", 0.0, True), ("disagreement_rate", 0.10, False))


def release_gate(metrics: DataFrame) -> DataFrame:
    """metrics with status and blocked_by (the first gate that fails; a missing metric fails)."""
    chain = None
    for name, bound, least in (*GATES, *RUN_GATES):
        value = F.col(name).cast("double")
        fails = ~F.coalesce(value >= bound if least else value <= bound, F.lit(False))
        chain = F.when(fails, name) if chain is None else chain.when(fails, name)
    return metrics.withColumn("blocked_by", chain).withColumn("status", F.when(F.col("blocked_by").isNull(), "promoted").otherwise("blocked"))


def compare_release(candidate: DataFrame, active: DataFrame, key: str = "model_name") -> DataFrame:
    """A row for each gate of a release: metric, candidate, active, delta, passed. A missing candidate value is 0; without an active model all pass.

    regression_risk comes from the replay and is no comparison.
    """
    gates = [g for g in GATES if g[0] != "regression_risk"]
    value = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    long = lambda df, v: df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(m).alias("least"), (value(n) if n in df.columns else F.lit(0.0)).alias(v)) for n, _, m in gates])).alias("x")).select(key, "x.*")
    j = long(candidate, "candidate").join(long(active, "active").drop("least"), [key, "metric"], "left")
    delta = F.col("candidate") - F.col("active")
    return j.withColumns({"passed": F.col("active").isNull() | F.when(F.col("least"), delta >= 0).otherwise(delta <= 0), "delta": F.round(delta, 4)}).drop("least")


def _expected(field: str, value: Column) -> Column:
    value = s.filled(value)
    return s.street(value) if field == "street_name" else s.unit_number(value) if field == "unit_number" else value


def benchmark_rows(cases: DataFrame, results: DataFrame, fields: tuple[str, ...] = BENCHMARK_FIELDS) -> DataFrame:
    """case_id, field, expected, predicted, matched for each field that a case's expected (JSON) names, be it as null; both sides normalised."""
    j = cases.select("case_id", "expected").join(results.select("case_id", *fields), "case_id", "left")
    struct = [F.struct(F.lit(f).alias("field"), F.array_contains(F.json_object_keys("expected"), f).alias("present"), _expected(f, F.get_json_object("expected", f"$.{f}")).alias("expected"), _expected(f, F.col(f)).alias("predicted")) for f in fields]
    rows = j.select("case_id", F.explode(F.array(*struct)).alias("x")).select("case_id", "x.*").where("present").drop("present")
    return rows.withColumn("matched", F.col("expected").eqNullSafe(F.col("predicted")))


def benchmark_report(cases: DataFrame, results: DataFrame, fields: tuple[str, ...] = BENCHMARK_FIELDS) -> DataFrame:
    """field, total, matched, accuracy."""
    counted = benchmark_rows(cases, results, fields).groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"))
    return counted.withColumn("accuracy", rate(F.col("matched"), F.col("total")))


def benchmark_failures(cases: DataFrame, results: DataFrame, limit: int = 50) -> DataFrame:
    """The first failures in the order of cases and fields."""
    at = F.array_position(F.array(*[F.lit(f) for f in BENCHMARK_FIELDS]), F.col("field"))
    return benchmark_rows(cases, results).where("NOT matched").orderBy("case_id", at).limit(limit).drop("matched")
