import json

import pytest

from pyspark.sql import functions as F

from waymark.operators import evaluate, models, release
from waymark.operators.decision import DecisionPolicy, validate
from waymark.operators.keyed_table import KeyedTable
from waymark.sources import ingest

RAW = "workspace_name string, raw_id long, raw_address_text string, city string, province string, postal_code string, country_code string, latitude double, longitude double, is_active boolean"
REFERENCE = "workspace_name string, reference_id long, external_id string, street_number string, street_name string, province string, city string, unit_number string, reference_lat double, reference_lon double, quality_score double, is_active boolean"
RESULT = "workspace_name string, raw_id long, decision string, building_type string, unit_number string, confidence double, reference_score double"
GOLD = "workspace_name string, source_id string, gold_label_id long, gold_decision string, gold_building_type string, gold_unit_number string, gold_street_name string, review_status string, label_source string"
TEXTS = ["101-123 Main St, Halifax, NS", "# 7 12 Oak Ave", "12 Oak Ave, 7", "12 Oak Ave", "Suite 5 12 Oak Ave", "no address", None, "1550 Bedford Highway Suite 301"]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([("w", i, t, "Halifax", "NS", None, "CA", 44.6, -63.6, True) for i, t in enumerate(TEXTS)], RAW)


@pytest.fixture
def refs(spark):
    return spark.createDataFrame([("w", 1, "r1", "12", "OAK AVE", "NS", "Halifax", "7", 44.6, -63.6, 0.95, True)], REFERENCE)


def test_policy_by_hand(spark):
    """Building types are the labels', a decision "correct" is no accept, a missing confidence is 0.0."""
    gold = [("w", "1", 1, "Accept ", "commercial", None, None, "accepted", "human"), ("w", "2", 2, "accept", "Multi_Unit", None, None, "accepted", "human"), ("w", "3", 3, "correct", "commercial", None, None, "accepted", "human"), ("w", "4", 4, "accept", "commercial", None, None, "accepted", "model"), ("w", "5", 5, "accept", "commercial", None, None, "pending", "human")]
    results = [("w", 1, "accept", "single_unit", None, 0.95, None), ("w", 2, "accept", "single_unit", None, 0.80, 0.0), ("w", 3, "accept", "commercial", None, 0.75, 0.9), ("w", 4, "accept", "commercial", None, 0.1, 0.7), ("w", 5, "accept", "commercial", None, 0.1, 0.6)]
    learned = lambda g, r: evaluate.learned_policy(spark.createDataFrame(g, GOLD), spark.createDataFrame(r, RESULT)).first()
    got = learned(gold, results)
    assert (got.commercial_accept, got.multi_unit_accept, got.high_confidence_accept) == (0.94, 0.79, 0.79)
    assert (got.moderate_review, got.gps_weak_match, got.gps_conflict) == (0.62, 0.9, 0.85)
    got = learned([(*gold[0][:3], "review", *gold[0][4:]), (*gold[1][:3], "reject", *gold[1][4:])], [(*results[0][:5], None, None), results[1]])
    assert (got.moderate_review, got.parser_disagreement_review, got.commercial_review, got.commercial_accept) == (0.81, 0.4, 0.4, 0.88)


def test_weights_are_read_where_training_writes_them(spark, tmp_path):
    trained = models.Model("m", "2", "CA_V2", ("simple_rule",), DecisionPolicy(high_confidence_accept=0.7, parser_weights={"simple_rule": 0.25}))
    path = f"file://{tmp_path}/m.json"
    models.write_artifact(spark, trained, path)
    assert models.model_of(models.read_artifact(spark, path), "m", "2") == trained
    assert ingest.read_weights(spark, path) == {"simple_rule": 0.25}
    registry = spark.createDataFrame([("w", "m", "2", False, None, path, 2), ("w", "old", "1", True, "CA", None, 1), ("w", "gone", "3", False, None, f"{path}-none", 3)], "workspace_name string, model_name string, model_version string, is_default boolean, default_profile string, artifact_path string, updated_at long")
    assert models.registered_model(spark, registry, "w", "2") == trained
    assert models.registered_model(spark, registry, "w") == models.Model("old", "1", "CA")
    assert models.registered_model(spark, registry, "w", "3") == models.Model("gone", "3")
    with pytest.raises(ValueError):
        models.registered_model(spark, registry, "x")
    odd = models.model_of({"parsers": [], "profile": " ", "decision_policy": {"commercial_accept_threshold": "0.5", "gps_conflict_threshold": "no", "parser_weights": {"a": True, "b": "0.5"}}}, "odd")
    assert odd == models.Model("odd", policy=DecisionPolicy(commercial_accept=0.5, parser_weights={"b": 0.5}))
    assert models.model_of({"decision_policy": [1]}, "x") == models.Model("x")


def test_each_model_says_what_it_says_alone(spark, raw, refs):
    several = [
        models.Model("default"), models.Model("strict", policy=DecisionPolicy(high_confidence_accept=0.99, moderate_review=0.9, close_candidate_delta=0.5)),
        models.Model("two", parsers=("hybrid_canada", "simple_rule"), policy=DecisionPolicy(parser_weights={"simple_rule": 1.0, "hybrid_canada": 0.2})), models.Model("second", profile="CA_V2", parsers=("hybrid_canada", "unknown")),
    ]
    both = models.validate_models(raw, refs, several)
    columns = ["raw_id", "parser_name", "parse_score", "decision", "reason", "confidence", "building_type", "street_number", "street_name", "unit_number", "suggested_unit", "parser_disagreement", "canonical_full_key", "reference_id"]
    for m in several:
        alone = validate(raw, refs, m.policy, m.profile, m.parsers).select(columns)
        got = both.where(F.col("model") == m.name).select(columns)
        assert got.exceptAll(alone).count() == 0 == alone.exceptAll(got).count(), m.name
    plan = models.validate_models(raw, refs, several[:3])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    with pytest.raises(ValueError):
        models.validate_models(raw, refs, [models.Model("x", parsers=("unknown",))])
    with pytest.raises(ValueError):
        models.validate_models(raw, refs, several[:1] * 2)


def test_replay_compares_values_as_they_stand(spark):
    """"# 5" is not "5" in a replay and is in a shadow run; null equals the empty text in matches, not in what is different."""
    raw = spark.createDataFrame([("w", i, "t", None, None, None, "CA", None, None, True) for i in (1, 2)], RAW)
    of = lambda *rows: spark.createDataFrame([("w", *r, None, None) for r in rows], RESULT)
    current, active = of((1, "accept", "multi_unit", "5"), (2, "accept", "single_unit", None)), of((1, "accept", "multi_unit", "5"), (2, "accept", "single_unit", ""))
    candidate = of((1, "accept", "multi_unit", "# 5"), (2, "accept", "single_unit", None))
    got = release.replay_run(raw, current, candidate, active).first()
    assert (got.processed, got.mismatches, got.unit_number_match_rate, got.active_current_match_rate, got.candidate_current_match_rate) == (2, 2, 0.5, 1.0, 0.5)
    shadow = release.shadow_run(raw, current, candidate, active).first()
    assert (shadow.disagreement_rate, shadow.candidate_match_rate) == (0.0, 1.0)


def test_models_run_in_replay_and_shadow(spark, raw, refs, tmp_path):
    current = spark.createDataFrame([("w", 3, "accept", "single_unit", "7", None, None)], RESULT)
    active, candidate = models.Model("m", "1"), models.Model("m", "2", parsers=("simple_rule",))
    rows = release.replay_models(raw, refs, current, candidate, active)
    got = {r.raw_id: r for r in rows.collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    assert (got[0].a_unit_number, got[0].c_unit_number, got[0].different) == ("101", None, True)
    assert (got[3].a_unit_number, got[3].c_unit_number, got[3].different, got[3].active_current, got[3].candidate_current) == ("7", "7", False, True, True)
    results = KeyedTable(spark, f"file://{tmp_path}/results", ["workspace_name", "run_id", "raw_id"], buckets=2)
    runs = KeyedTable(spark, f"file://{tmp_path}/runs", ["workspace_name", "run_id"], buckets=2)
    for _ in range(2):
        release.stored_replay(rows, "r1", results, runs, "m", "2")
    release.stored_replay(rows.where("raw_id < 3"), "r2", results, runs, "m", "3")
    assert results.read().count() == len(TEXTS) + 3
    whole = release.replay_counts(rows).first()
    run = runs.read().where("run_id = 'r1'").first()
    assert (run.processed_count, run.failures, run.decision_match_rate, run.disagreement_rate, run.model_version) == (whole.processed, 0, whole.decision_match_rate, whole.disagreement_rate, "2")
    samples = release.stored_mismatches(results, "r2", 1).collect()
    assert [(r.raw_id, r.raw_address_text) for r in samples] == [(max(i for i in range(3) if got[i].different), TEXTS[max(i for i in range(3) if got[i].different)])]
    shadow = release.shadow_counts(release.shadow_models(raw, refs, current, candidate, active, limit=5)).first()
    assert (shadow.compared, shadow.decision) == (5, "keep_active")


def test_parsers_alone_by_hand(spark, refs):
    lines = [("101-123 Main St, Halifax, NS", {"street_number": "123", "street_name": "main  st", "unit_number": "#101", "decision": "accept"}), ("12 Oak Ave", {"street_number": "12", "unit_number": None})]
    cases = spark.createDataFrame([(i, json.dumps(e)) for i, (_, e) in enumerate(lines)], "case_id long, expected string")
    raw = spark.createDataFrame([("w", i, t, None, None, None, "CA", None, None, True) for i, (t, _) in enumerate(lines)], RAW)
    got = {(r.parser_name, r.field): (r.total, r.matched) for r in models.parsers_alone(cases, raw, refs.limit(0)).collect()}
    assert got["hybrid_canada", "street_number"] == (2, 2) and got["hybrid_canada", "unit_number"] == (2, 2) and got["libpostal", "street_number"] == (2, 1)
    assert got["simple_rule", "unit_number"] == (2, 1) and ("simple_rule", "building_type") not in got
    weights = {r.parser_name: (r.score, r.weight) for r in models.learned_weights(cases, raw, refs.limit(0)).collect()}
    accuracy = lambda p, f: got.get((p, f), (1, 0))[1] / got.get((p, f), (1, 0))[0]
    scores = {p: round(sum(accuracy(p, f) for f in evaluate.BENCHMARK_FIELDS) / 5, 4) for p in ("simple_rule", "hybrid_canada", "libpostal")}
    assert weights == {p: (v, round(v / sum(scores.values()), 4)) for p, v in scores.items()}
    none = models.learned_weights(cases.limit(0), raw.limit(0), refs.limit(0)).collect()
    assert {(r.parser_name, r.score, r.weight) for r in none} == {(p, 0.0, 0.3333) for p in scores}


def test_features_are_keyed_by_the_parser(spark):
    gold = spark.createDataFrame([("w", "1", 1, "accept", "single_unit", None, "Oak Ave", "accepted", "human"), ("w", "2", 2, "accept", "single_unit", None, "Elm Lane", "accepted", "human"), ("w", "3", 3, "accept", "single_unit", None, None, "accepted", "human")], GOLD)
    results = spark.createDataFrame([("w", i, "Accept", "single_unit", None, 0.9, p, u, "OAK  AVE", 0, 0, 0) for i, p, u in ((1, "hybrid_canada", "street_standard"), (2, "hybrid_canada", None), (3, "", "leading_hyphen"))], "workspace_name string, raw_id long, decision string, building_type string, unit_number string, confidence double, parser_name string, unit_source string, street_name string, regex_hit int, is_commercial int, llm_involved int")
    raw = spark.createDataFrame([("w", i, "12 Oak Ave", "b3j") for i in (1, 2, 3)], "workspace_name string, raw_id long, raw_address_text string, postal_code string")
    found = release.training_features(gold, results, raw)
    assert {(r.gold_label_id, r.unit_source, r.target_is_correct, r.fsa_prefix) for r in found.collect()} == {(1, "hybrid_canada", 1, "B3J"), (2, "hybrid_canada", 0, "B3J"), (3, "leading_hyphen", 1, "B3J")}
    assert {(r.unit_source, r.precision, r.n) for r in evaluate.reranking_weights(found).collect()} == {("hybrid_canada", 0.5, 2), ("leading_hyphen", 1.0, 1)}
