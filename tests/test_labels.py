import json
import time

import pytest

from pyspark.sql import functions as F

from waymark.operators import label_json, labels, upsert
from waymark.operators.decision import validate
from waymark.sources import schema, tables


def test_labels_from_json(spark):
    texts = [
        ('{"decision": " Correct ", "structure_type": "commercial", "building_type": "", "canonical": {"unit_number": "# 5"}}', ("accept", "commercial", "5", None)),
        ('{"decision": "review", "unit_number": 7, "suggested_unit_number": "8", "street_name": " Main St "}', ("review", None, "7", "Main St")),
        ('{"unit_number": 0, "suggested_unit_number": "0", "canonical": 5}', (None, None, "0", None)),
        ('{"unit_number": null, "canonical": {"unit_number": null, "street_name": "Oak"}}', (None, None, None, "Oak")),
        ('{"decision": "accept"', (None,) * 4), ('["accept"]', (None,) * 4), ('"accept"', (None,) * 4), ("12", (None,) * 4), ("", (None,) * 4), (None, (None,) * 4), ("{}", (None,) * 4),
    ]
    gold = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(texts)], "i int, label_json string, gold_decision string")
    rows = label_json.with_labels(gold).orderBy("i").collect()
    assert [(r.gold_decision, r.gold_building_type, r.gold_unit_number, r.gold_street_name) for r in rows] == [w for _, w in texts]


def test_parse_payload(spark):
    texts = ['{"best_candidate": {"parsed": {"street_number": 12, "unit_number": null, "parse_confidence": 0.5}}}', '{"best_candidate": null}', "[1]", "no json", None, '{"best_candidate": {"parsed": "x"}}']
    rows = spark.createDataFrame([(i, t, "7", 0.9) for i, t in enumerate(texts)], "i int, t string, u string, c double").select("i", label_json.parse_payload("t", "u", "c").alias("p")).orderBy("i").collect()
    other = (None, None, "7", 0.9)
    assert [tuple(r.p) for r in rows] == [("12", None, None, 0.5), (None,) * 4, other, other, other, other]


def test_reviews_are_completed_from_the_result(spark):
    queue = spark.createDataFrame([(i, "w", "" if i == 2 else "raw", str(i), "decision", "queued", 0.4) for i in range(1, 5)], "queue_id long, workspace_name string, source_name string, source_id string, task_type string, status string, confidence double")
    results = spark.createDataFrame([("w", i, "multi_unit", "5", "because") for i in (1, 2)], "workspace_name string, raw_id long, building_type string, unit_number string, reason string")
    reviews = spark.createDataFrame([(1, "correct", None, None, "n"), (2, "reject", "commercial", "", None), (3, "review", "", None, None), (99, "accept", None, None, None)], "queue_id long, decision string, building_type string, unit_number string, notes string")
    made, after = labels.submit_reviews(queue, reviews, results)
    got = {r.queue_id: (r.source_name, json.loads(r.label_json), r.score, r.notes) for r in made.collect()}
    label = lambda d, b, u, why, a: {"decision": d, "building_type": b, "unit_number": u, "reason": why, "review_action": a}
    assert got == {1: ("raw", label("accept", "multi_unit", "5", "because", "correct"), 0.4, "n"), 2: ("active_learning_queue", label("reject", "commercial", "", "because", "reject"), 0.4, None), 3: ("raw", label("review", None, None, None, "review"), 0.4, None)}
    assert {r.queue_id: r.status for r in after.collect()} == {1: "labeled", 2: "labeled", 3: "labeled", 4: "queued"}


def test_errors_of_the_newest_evaluation(spark):
    stored = {"decision_errors": [{"source_id": 1, "confidence": 0.5}, {"source_id": "2"}, {"source_id": "3", "confidence": 0.1}, {"confidence": 0.0}, {"source_id": "4", "confidence": 0.5}]}
    kind = "workspace_name string, status string, created_at int, metrics_json string"
    models = spark.createDataFrame([("w", "evaluated", 2, json.dumps(stored)), ("w", "evaluated", 1, '{"decision_errors": [{"source_id": "old"}]}'), ("w", "registered", 3, "{}"), ("v", "evaluated", 9, "no json")], kind)
    rows = labels.errors_in_metrics(models, "decision", "w", 3)
    assert [(r.source_id, r.priority) for r in rows.collect()] == [("3", 100), ("1", 100), ("4", 100)]
    for field, workspace in (("unit_number", "w"), ("decision", "v"), ("decision", "none")):
        assert labels.errors_in_metrics(models, field, workspace).count() == 0
    queue = spark.createDataFrame([("w", "evaluation_error", "3", "decision", 5, "labeled", "old", "mine"), ("w", "raw", "3", "decision", 5, "labeled", "old", "mine")], "workspace_name string, source_name string, source_id string, task_type string, priority int, status string, reason string, notes string")
    merged = upsert.merge(queue, rows, ["workspace_name", "source_name", "source_id", "task_type"])
    assert {(r.source_name, r.source_id, r.priority, r.status, r.notes) for r in merged.collect()} == {("evaluation_error", "3", 100, "queued", "mine"), ("raw", "3", 5, "labeled", "mine"), ("evaluation_error", "1", 100, "queued", None), ("evaluation_error", "4", 100, "queued", None)}


def test_any_observed_locality_may_fit(spark):
    refs = spark.createDataFrame([("w", 1, "r1", "12", "OAK AVE", "NS", None, "Bedford", "7", None, None, 1.0, True)], "workspace_name string, reference_id long, external_id string, street_number string, street_name string, province string, city string, municipality string, unit_number string, reference_lat double, reference_lon double, quality_score double, is_active boolean")
    raw = spark.createDataFrame([("w", i, "12 Oak Ave", c, "NS", None, "CA", None, None, m, k) for i, (c, m, k) in enumerate([("Truro", None, None), ("Truro", "bedford", None), ("Truro", "Truro", "Bedford Basin"), ("Truro", "Truro", "Pictou")])], "workspace_name string, raw_id long, raw_address_text string, city string, province string, postal_code string, country_code string, latitude double, longitude double, municipality string, county string")
    found = validate(raw, refs, localities=("city", "municipality"), observed=("city", "municipality", "county"))
    assert {r.raw_id: r.reference_score for r in found.collect()} == {0: None, 1: 0.775, 2: 0.775, 3: None}


def test_newest_files_without_reading_them(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"report{i}.md").write_text("x" * i)
        time.sleep(0.05)
    files = tables.newest_files(spark, f"file://{tmp_path}/*.md", 3)
    assert [(r.name, r.length) for r in files.collect()] == [("report3.md", 3), ("report2.md", 2), ("report1.md", 1)]
    assert "content" not in files._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_scripts_and_tables_that_grow(spark, tmp_path):
    script = """-- a comment; not a statement
    CREATE TEMPORARY VIEW a AS SELECT 'x;y' AS t, "it's -- no comment" AS u; /* ; */
    ;; CREATE TEMPORARY VIEW b AS SELECT 'it\\'s; ' AS t, `t` AS `odd;name` FROM a"""
    assert len(list(schema.statements(script))) == 2 == schema.execute_script(spark, script)
    assert tuple(spark.table("a").first()) == ("x;y", "it's -- no comment") and tuple(spark.table("b").first()) == ("it's; ", "x;y")
    assert list(schema.statements("'open; quote")) == ["'open; quote"] and list(schema.statements("/* open")) == []
    where = f"file://{tmp_path}/t"
    spark.sql("DROP TABLE IF EXISTS grown")
    assert schema.ensure(spark, "grown", "a int, b string", where) == ["a", "b"]
    spark.sql("INSERT INTO grown VALUES (1, 'x')")
    assert schema.ensure(spark, "grown", "a int, B string, c double") == ["c"] and schema.ensure(spark, "grown", "a int, c double") == []
    assert tuple(spark.table("grown").first()) == (1, "x", None)
    with pytest.raises(ValueError):
        schema.ensure(spark, "grown", "a string")
    spark.sql("DROP TABLE grown")
    for columns in schema.CONTROL.values():
        assert spark.createDataFrame([], columns).columns
