import json

import pytest

from pyspark.sql import functions as F

from waymark.operators.keyed_table import KeyedTable
from waymark.operators.upsert import VersionedTable
from waymark.streaming import stages
from waymark.streaming.cleaning import clean_stream

RAW = "workspace_name string, raw_id long, raw_address_text string, city string, province string, postal_code string, country_code string, latitude double, longitude double, is_active boolean"
REFERENCE = "workspace_name string, reference_id long, external_id string, street_number string, street_name string, province string, city string, unit_number string, reference_lat double, reference_lon double, quality_score double, is_active boolean"


@pytest.fixture
def raw(spark):
    rows = [("w", i, f"{i} Oak Ave" if i != 3 else None, "Halifax", "NS", None, "CA", None, None, True) for i in range(1, 9)]
    rows += [("w", 9, "basement bsmt", "Halifax", "NS", None, "CA", None, None, True)]
    return spark.createDataFrame(rows, RAW)


@pytest.fixture
def cleaner(spark):
    refs = spark.createDataFrame([("w", 1, "r1", "5", "OAK AVE", "NS", "Halifax", "B", 44.6, -63.6, 0.95, True)], REFERENCE)
    return stages.Cleaner(refs, checks={"parse": F.when(F.col("raw_address_text").isNull(), "no text")})


def state(table):
    return {r.raw_id: r for r in table.read().collect()}


@pytest.mark.parametrize("stop", stages.STAGES[1:])
def test_a_run_cut_off_in_any_stage_is_taken_up(spark, tmp_path, raw, cleaner, stop, monkeypatch):
    table = stages.results_table(spark, f"file://{tmp_path}/t", buckets=2)
    real, did, killed = stages.run_stage, [], []

    def counted(stage, rows, *rest):
        did.append((stage, stages.eligible(stage, rows, table).count()))
        if stage == stop and not killed:
            killed.append(stage)
            raise RuntimeError("killed")
        return real(stage, rows, *rest)

    monkeypatch.setattr(stages, "run_stage", counted)
    with pytest.raises(RuntimeError):
        stages.clean(raw, table, cleaner)
    done = stages.STAGES.index(stop)
    before = state(table) if done else {}
    assert all(sum(r[p] is not None for p in stages.PAYLOADS.values()) == (done if i != 3 else min(done, 1)) for i, r in before.items())
    did.clear()
    stages.clean(raw, table, cleaner)
    want = {"normalize": 9, "parse": 9, "validate": 8, "publish": 8}  # the row without a text is tried by the parser, and again in each run
    assert dict(did) == {s: want[s] if k >= done else 1 if s == "parse" else 0 for k, s in enumerate(stages.STAGES)}
    after = state(table)
    assert {i: (r.checkpoint_stage, r.checkpoint_status, r.checkpoint_error) for i, r in after.items()} == {i: ("publish", "completed", None) if i != 3 else ("parse", "failed", "no text") for i in range(1, 10)}
    assert after[5].decision == "accept" and json.loads(after[5].reference_json)["external_id"] == "r1" and json.loads(after[5].validation_json)["canonical"]["street_number"] == "5"
    assert after[3].decision == "pending" and after[3].normalize_json is not None and after[3].parser_json is None
    did.clear()
    assert stages.clean(raw.where("raw_id <> 3"), table, cleaner) == {s: [] for s in stages.STAGES}
    assert did == [(s, 0) for s in stages.STAGES]


def test_payloads_keep_what_is_stored(spark, tmp_path, raw, cleaner):
    table = stages.results_table(spark, f"file://{tmp_path}/t", buckets=2)
    table.upsert(spark.createDataFrame([("w", 1, '{"mine": 1}', "kept")], "workspace_name string, raw_id int, normalize_json string, reason string"))
    stages.clean(raw.where("raw_id IN (1, 3)"), table, cleaner)
    assert state(table)[1].normalize_json == '{"mine": 1}' and state(table)[1].checkpoint_status == "completed"
    fixed = raw.where("raw_id = 3").withColumn("raw_address_text", F.lit("3 Elm Lane"))
    stages.clean(fixed, table, cleaner)
    assert (state(table)[3].checkpoint_status, state(table)[3].checkpoint_error) == ("completed", None)
    assert {tuple(r) for r in stages.progress(table).collect()} == {("publish", "completed", 2)}


def test_refiner_sees_doubtful_rows(spark, tmp_path, raw, cleaner):
    table = stages.results_table(spark, f"file://{tmp_path}/t", buckets=2)
    only = stages.Cleaner(cleaner.references, parsers=("hybrid_canada",), refine=True)
    stages.clean(raw.where("raw_id IN (5, 9)"), table, only)
    doubtful, sure = state(table)[9], state(table)[5]
    assert doubtful.reason == "LLM REFINED: Heuristic segment matching confirmed Basement." and doubtful.confidence <= 0.95
    assert json.loads(json.loads(doubtful.validation_json)["llm_refinement"])["unit_number"] == "BSMT"
    assert not sure.reason.startswith("LLM")


def test_pages_go_on_up_to_the_first_failure(spark, tmp_path, raw, cleaner):
    table = stages.results_table(spark, f"file://{tmp_path}/t", buckets=2)
    settings = VersionedTable(spark, f"file://{tmp_path}/settings")
    page = lambda rows, size: stages.clean_page(rows, table, settings, cleaner, "w", size)
    assert page(raw, 2) == {"records_seen": 2, "records_processed": 2, "next_raw_id": 2, "has_more": True, "failed_raw_id": None}
    assert page(raw, 4) == {"records_seen": 4, "records_processed": 3, "next_raw_id": 2, "has_more": True, "failed_raw_id": 3}
    fixed = raw.fillna({"raw_address_text": "3 Oak Ave"})
    assert page(fixed, 100) == {"records_seen": 7, "records_processed": 7, "next_raw_id": 9, "has_more": False, "failed_raw_id": None}
    assert page(fixed, 100)["next_raw_id"] == 9


def test_streams_write_keyed_tables(spark, tmp_path, raw, cleaner):
    raw.drop("is_active").write.parquet(f"{tmp_path}/in")
    table = stages.results_table(spark, f"file://{tmp_path}/t", buckets=2)
    plain = KeyedTable(spark, f"file://{tmp_path}/p", stages.KEYS, buckets=2)
    for k in range(2):
        stream = spark.readStream.schema(RAW.replace(", is_active boolean", "")).parquet(f"{tmp_path}/in")
        stages.staged_stream(stream, table, cleaner, f"{tmp_path}/c{k}").awaitTermination()
        clean_stream(stream, cleaner.references, plain, f"{tmp_path}/d{k}").awaitTermination()
        assert table.read().where("checkpoint_status = 'completed'").count() == 8 and plain.read().count() == 9
    both = table.read().where("raw_id <> 3").select("raw_id", "decision", "confidence")
    assert both.exceptAll(plain.read().select("raw_id", "decision", "confidence")).count() == 0
