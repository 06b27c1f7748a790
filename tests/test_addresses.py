import duckdb
import pytest

from pyspark.sql import functions as F

from waymark import queries
from waymark.functions import scalars as s
from waymark.functions.profile import get_profile
from waymark.operators import candidates, labels, upsert
from waymark.operators.decision import DecisionPolicy, validate
from waymark.operators.reference import gathered, match_reference
from waymark.sources import ingest, tables
from waymark.streaming.cleaning import clean_stream

DATA = "/root/testdata/sf0.001"
REFERENCE = "workspace_name string, reference_id long, external_id string, street_number string, street_name string, province string, city string, unit_number string, reference_lat double, reference_lon double, quality_score double, is_active boolean"
RAW = "workspace_name string, raw_id long, raw_address_text string, city string, province string, postal_code string, country_code string, latitude double, longitude double"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name, tmp_path):
    queries.Q[name](spark, DATA).write.parquet(f"{tmp_path}/q")
    c = duckdb.connect()
    for t in ("orders", "customer", "events", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    c.execute(f"CREATE TABLE a AS SELECT * FROM '{tmp_path}/q/*.parquet'")
    c.execute("CREATE TABLE b AS " + queries.SQL[name])
    names = ", ".join(f'"{r[0]}"' for r in sorted(c.execute("DESCRIBE a").fetchall()))
    for x, y in (("a", "b"), ("b", "a")):
        assert c.execute(f"SELECT {names} FROM {x} EXCEPT ALL SELECT {names} FROM {y}").fetchall() == []


def test_plans_have_no_nested_loop_and_no_python(spark):
    for name in ("validate_decision", "gold_compare", "canonical_building"):
        plan = queries.Q[name](spark, DATA)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "EvalPython" not in plan


def test_title_case_as_python(spark):
    texts = ["st. john's", "o'brien-smith", "ÉCOLE  du nord", "a1b 2c", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(s.city_name("t")).collect()
    assert [r[0] for r in rows] == [(" ".join((t or "").split()).title() or None) for t in texts]


def test_bucket_is_md5_modulo(spark):
    import hashlib

    texts = [f"w|{i}|eval" for i in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(s.md5_bucket(F.col("t"), 100)).collect()
    assert [r[0] for r in rows] == [int(hashlib.md5(t.encode()).hexdigest(), 16) % 100 for t in texts]


CASES = [  # text, winning parser, number, street, unit
    ("2060 Quingate Place", "hybrid_canada", "2060", "QUINGATE PLACE", None),
    ("1550 Bedford Highway Suite 301", "hybrid_canada", "1550", "BEDFORD HIGHWAY SUITE 301", None),
    ("101-123 Main St, Halifax, NS", "hybrid_canada", "123", "MAIN ST", "101"),
    ("# 7 12 Oak Ave", "hybrid_canada", "12", "OAK AVE", "7"),
    ("12 Oak Ave, 7", "hybrid_canada", "12", "OAK AVE", "7"),
    ("Suite 5 12 Oak Ave", "hybrid_canada", "12", "OAK AVE", "SUITE"),  # D2: the label becomes the unit
    ("no address here", "libpostal", "123", "MAIN ST", None),  # D1: the stub wins where nothing else parses
    ("", "libpostal", "123", "MAIN ST", None),
    (None, "libpostal", "123", "MAIN ST", None),
]


def test_parity_cases(spark):
    df = spark.createDataFrame([("w", i, c[0], None, None, None, "CA", None, None) for i, c in enumerate(CASES)], RAW)
    p = F.col("best")["parsed"]
    rows = candidates.parsed(df).select("raw_id", F.col("best")["parser_name"], p["street_number"], p["street_name"], p["unit_number"]).orderBy("raw_id").collect()
    assert [tuple(r)[1:] for r in rows] == [c[1:] for c in CASES]
    v2 = candidates.parsed(df, get_profile("CA_V2")).where("raw_id = 5").select(F.col("best")["parsed"]["unit_number"]).first()[0]
    assert v2 == "5"
    assert candidates.parsed(df, drop_stub=True).where("raw_id = 6").select(F.col("best")["parser_name"]).first()[0] == "simple_rule"


def test_reference_decides_and_ties_take_the_least_id(spark):
    refs = spark.createDataFrame([("w", i, f"r{i}", "12", "OAK AVE", "NS", "Halifax", u, 44.6, -63.6, 0.95, True) for i, u in ((3, "B"), (2, "A"))], REFERENCE)
    raw = spark.createDataFrame([("w", 1, "12 Oak Ave", "Halifax", "NS", None, "CA", 44.6, -63.6), ("other", 2, "12 Oak Ave", "Halifax", "NS", None, "CA", 44.6, -63.6)], RAW)
    rows = {r["raw_id"]: r for r in validate(raw, refs, DecisionPolicy()).collect()}
    assert (rows[1]["reference_id"], rows[1]["reference_score"], rows[1]["reference_units"], rows[1]["suggested_unit"], rows[1]["decision"]) == (2, 0.9875, ["A", "B"], "A", "accept")
    assert rows[2]["reference_id"] is None and rows[2]["decision"] == "accept"  # D23: references of another workspace don't count


def test_references_of_one_place_are_ranked_once(spark):
    point = lambda i: (44.6, -63.6, 0.95) if i % 2 else (None, None, 0.82)
    refs = spark.createDataFrame([("w", i, f"r{i}", "12", "Oak Ave", "NS", ("Halifax", "Bedford")[i // 2 % 2], str(i % 7) if i % 3 else None, *point(i), i > 2) for i in range(400, 0, -1)], REFERENCE)
    address = gathered(refs).first()
    assert (len(address["__refs"]), address["__k"], address["__u"]) == (4, 398, [str(i) for i in range(7)])
    seen = [(44.6, "Halifax"), (44.6, "Bedford"), (None, "Halifax"), (45.0, "Bedford"), (44.6, None), (44.6, "Truro")]
    rows = spark.createDataFrame([("w", n, "12", "OAK AVE", "NS", city, lat, -63.6) for n, (lat, city) in enumerate(seen)], "workspace_name string, raw_id int, street_number string, street_name string, province string, city string, latitude double, longitude double")
    got = {r.raw_id: (r.reference_id, r.reference_external_id, r.reference_score, r.reference_candidates) for r in match_reference(rows, refs).collect()}
    found = {n: (i, f"r{i}", score, 398) for n, i, score in ((0, 5, 0.9875), (1, 3, 0.9875), (2, 5, 0.8525), (4, 3, 0.9875))}
    assert got == found | {n: (None,) * 4 for n in (3, 5)}


def test_merge_rules_and_idempotence(spark):
    old = spark.createDataFrame([("a", 1, None, ["x"]), (None, 2, "k", ["y"])], "k string, v int, c string, s array<string>")
    new = spark.createDataFrame([("a", 5, "n", ["x", "z"]), (None, 6, None, ["y"]), ("b", 7, None, None)], old.schema)
    rules = {"c": upsert.COALESCE, "s": upsert.APPEND}
    out = upsert.merge(old, new, ["k"], rules)
    want = {("a", 5, "n", ("x", "z")), (None, 6, "k", ("y",)), ("b", 7, None, None)}
    as_set = lambda df: {(r.k, r.v, r.c, tuple(r.s) if r.s else None) for r in df.collect()}
    assert as_set(out) == want and as_set(upsert.merge(out, new, ["k"], rules)) == want


def test_release_gate_checks_replay_and_shadow(spark):
    from waymark.operators import evaluate

    good = {**{n: b for n, b, _ in evaluate.GATES}, "replay_failures": 0, "processed_samples": 1, "promote_recommended": True, "shadow_advantage": 0.0, "disagreement_rate": 0.10}
    bad = {"replay_failures": 1, "processed_samples": 0, "promote_recommended": False, "shadow_advantage": -0.01, "disagreement_rate": 0.11}
    cases = [(None, good), *[(n, {**good, n: v}) for n, v in bad.items()], *[(n, {**good, n: None}) for n in bad]]
    kind = ", ".join(f"{n} " + {"replay_failures": "int", "processed_samples": "long", "promote_recommended": "boolean"}.get(n, "double") for n in good)
    df = spark.createDataFrame([(i, *c.values()) for i, (_, c) in enumerate(cases)], f"i int, {kind}")
    got = {r.i: (r.blocked_by, r.status) for r in evaluate.release_gate(df).collect()}
    assert got == {i: (n, "blocked" if n else "promoted") for i, (n, _) in enumerate(cases)}


def test_cities_of_few_rows_meet(spark):
    raw = spark.createDataFrame([(1, "Halifax", "NS"), (2, "Bedford", "NS"), (3, "Gander", "NL")], "raw_id long, city string, province string")
    refs = spark.createDataFrame([(5, "Halifax", "NS"), (6, "Truro", "NS")], "reference_id long, city string, province string")
    got = {tuple(r) for r in queries.city_pairs(raw, refs).collect()}
    assert got == {("Halifax", "Halifax", True), ("Halifax", "Truro", False), ("Bedford", "Halifax", False), ("Bedford", "Truro", False)}


def test_priority_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(0.975,), (0.985,), (None,)], "c double").select(labels.priority(F.col("c"))).collect()
    assert [r[0] for r in rows] == [round((1 - (c or 0)) * 100) for c in (0.975, 0.985, None)]


def test_raw_records_take_the_first_filled_alias(spark):
    df = spark.createDataFrame([("1", "", "12 Oak", "x"), ("", "5 Elm", None, "y")], "id string, address_text string, address string, lat string")
    rows = ingest.raw_records(df, "csv").collect()
    assert [(r.external_id, r.raw_address_text, r.country_code, r.latitude) for r in rows] == [("1", "12 Oak", "CA", None)]


def test_pages_follow_the_cursor_and_retry():
    bodies, calls = {None: {"data": [{"i": 1}], "next_cursor": "a", "has_more": True}, "a": {"data": [{"i": 2}], "has_more": False}}, []

    def fetch(cursor):
        calls.append(cursor)
        if len(calls) == 1:
            raise OSError("try again")
        return bodies[cursor]

    assert list(ingest.pages_of(fetch)) == [[{"i": 1}], [{"i": 2}]] and calls == [None, None, "a"]


def test_counts_fill_zeros(spark):
    df = spark.createDataFrame([("queued",), ("queued",)], "status string")
    assert {tuple(r) for r in tables.counts_by(df, "status", ["queued", "failed"]).collect()} == {("queued", 2), ("failed", 0)}


def test_stream_publishes_each_row_once(spark, tmp_path):
    raw = spark.createDataFrame([("w", i, f"{i} Oak Ave", "Halifax", "NS", None, "CA", None, None) for i in range(1, 6)], RAW)
    refs = spark.createDataFrame([], REFERENCE)
    raw.write.parquet(f"{tmp_path}/in")
    for k in range(2):
        stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
        clean_stream(stream, refs, f"{tmp_path}/out", f"{tmp_path}/checkpoint{k}").awaitTermination()
    out = upsert.VersionedTable(spark, f"{tmp_path}/out").read()
    assert out.count() == 5 and out.where("decision = 'accept' AND status = 'completed'").count() == 5


def test_csv_import_counts_and_last_row_wins(spark, tmp_path):
    (tmp_path / "in.csv").write_text('order_id,delivery_address,zipcode,gps\n1,"1 Main St\nrear",B3J 1K1,"{""lat"": 44.5}"\n2,,B3J 1K1,\n1,2 Main St,,\n')
    table = upsert.VersionedTable(spark, f"file://{tmp_path}/raw")
    assert ingest.import_csv(spark, f"file://{tmp_path}/in.csv", table, "csv") == (3, 2)
    assert [(r.external_id, r.raw_address_text, r.postal_code) for r in table.read().collect()] == [("1", "2 Main St", None)]
    first = ingest.raw_records(ingest.read_csv(spark, f"file://{tmp_path}/in.csv"), "csv").first()
    assert (first.latitude, first.longitude) == (44.5, None)
    settings = upsert.VersionedTable(spark, f"file://{tmp_path}/settings")
    rows = spark.createDataFrame([("5", "a st", "2024-01-02"), ("6", "b st", "2024-01-03")], "id string, address string, updated_at string")
    assert ingest.cursor(settings, "api") is None
    assert ingest.run_once(ingest.raw_records(rows, "api"), table, settings, "api") == "2024-01-03" == ingest.cursor(settings, "api")
    assert ingest.run_once(ingest.raw_records(rows.limit(0), "api"), table, settings, "api") is None and ingest.cursor(settings, "api") == "2024-01-03"
    manifest = ingest.export_snapshot({"raw": (spark.createDataFrame([("default", 1, "a\nb"), ("default", 2, "c"), ("x", 3, "d")], "workspace_name string, raw_id long, t string"), "raw_id")}, f"file://{tmp_path}/out")
    assert [tuple(r) for r in manifest.collect()] == [("raw", 2)]


def test_golden_cases_end_to_end(spark, tmp_path):
    from waymark.operators import evaluate

    lines = ['{"raw_address_text": "101-123 Main St, Halifax, NS", "expected": {"street_number": "123", "street_name": "main  st", "unit_number": "#101"}}', "", '{"raw_address_text": "12 Oak Ave", "city": "Halifax", "expected": {"unit_number": null, "street_number": "13"}}']
    (tmp_path / "cases.jsonl").write_text("\n".join(lines))
    (tmp_path / "weights.json").write_text('{"decision_policy": {"parser_weights": {"simple_rule": 0.25, "x": "no"}}}')
    assert ingest.read_weights(spark, f"file://{tmp_path}/weights.json") == {"simple_rule": 0.25}
    cases = ingest.read_benchmark(spark, f"file://{tmp_path}/cases.jsonl")
    raw = cases.select(F.lit("w").alias("workspace_name"), F.col("case_id").alias("raw_id"), "raw_address_text", "city", "province", "postal_code", F.lit("CA").alias("country_code"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    results = validate(raw, spark.createDataFrame([], REFERENCE)).withColumnRenamed("raw_id", "case_id")
    report = {r.field: (r.total, r.matched) for r in evaluate.benchmark_report(cases, results).collect()}
    assert report == {"street_number": (2, 1), "street_name": (1, 1), "unit_number": (2, 2)}
    assert [(r.field, r.expected, r.predicted) for r in evaluate.benchmark_failures(cases, results).collect()] == [("street_number", "13", "12")]


def test_model_registry_and_report(spark):
    from waymark.operators import release

    models = spark.createDataFrame([("w", "m", "1", "promoted", True, 0.9), ("w", "m", "2", "evaluated", False, 0.95), ("v", "m", "1", "promoted", True, 0.8)], "workspace_name string, model_name string, model_version string, status string, is_default boolean, f1 double")
    update = spark.createDataFrame([("w", "m", "2", None, None, 0.97), ("w", "m", "3", "registered", False, None)], models.schema)
    out = {(r.workspace_name, r.model_version): (r.status, r.is_default, r.f1) for r in release.promoted(release.registered(models, update), "w", "m", "2").collect()}
    assert out == {("w", "1"): ("deprecated", False, 0.9), ("w", "2"): ("promoted", True, 0.97), ("w", "3"): ("registered", False, None), ("v", "1"): ("promoted", True, 0.8)}
    text = release.markdown({"decision_f1": 0.5}, [{"metric": "decision_f1", "candidate": 0.5, "active": None, "passed": True}])
    assert "| decision_f1 | 0.5000 | - | yes |" in text
    assert release.score_delta({"a": 0.5}, {"a": 0.4, "b": 0.2}, ("a", "b")) == -0.05
