import random
import sqlite3

import pytest

from pyspark.sql import functions as F

from waymark.operators import upsert
from waymark.operators.keyed_table import KeyedTable
from waymark.sources import ingest, page_stream

KEYS = ["workspace_name", "source_name", "external_id"]


def database(path, rows):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE IF NOT EXISTS raw (id INTEGER, updated_at INTEGER, address TEXT, src TEXT)")
    con.executemany("INSERT INTO raw VALUES (?, ?, ?, ?)", rows)
    con.commit()
    con.close()


def keyset(path, size=3, where=None):
    return page_stream.KeysetPages(lambda: __import__("sqlite3").connect(path), "raw", "updated_at", "id", size, where)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_keyset_stream_restarts_in_the_middle(spark, tmp_path, size):
    db, rng = f"{tmp_path}/x.db", random.Random(size)
    rows = [(i, rng.choice([9, 10, 10, 10, 11, 100]), f"{i} Oak Ave", rng.choice("ab")) for i in range(40)]  # equal and numeric cursors
    database(db, rows[:25] + [(99, None, "no cursor", "a")])
    source = keyset(db, size, {"a": "src = 'a'", "b": "src = 'b'"})
    fails = [True]

    def sink(batch, n):
        batch.write.mode("overwrite").json(f"{tmp_path}/out/b={n}")
        if n == 1 and fails:
            fails.clear()
            raise RuntimeError("stopped after the batch was written, before it was committed")

    def once():
        stream = page_stream.pages_stream(spark, f"keyset{size}", source, pages_a_batch=2, wait=0.01)
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    def run():
        try:
            once()
        except Exception:
            assert not fails
            once()

    run()
    run()
    late = [(i, 101 + c, a, s) for i, c, a, s in rows[25:]]
    database(db, late)
    run()
    assert not fails
    got = sorted(r.i for r in spark.read.json(f"{tmp_path}/out").select(F.get_json_object("record", "$.id").cast("int").alias("i")).collect())
    assert got == list(range(40))
    whole = spark.read.format(f"keyset{size}").load()
    assert sorted(r.i for r in whole.select(F.get_json_object("record", "$.id").cast("int").alias("i")).collect()) == list(range(40))
    assert whole.rdd.getNumPartitions() >= 40 // size


def test_open_page_of_an_api_is_taken_up(tmp_path):
    bodies = {None: {"result": {"items": [{"i": 0}, {"i": 1}, "no object"]}, "next_cursor": "p2", "status": "ok"}, "p2": {"records": [{"i": 2}]}}
    source = page_stream.pages(" Generic ", fetch=bodies.get, data_path="result.items", status="ok")
    at, seen = source.start(""), []

    def drain(at):
        while (step := source.step("", at)) is not None:
            seen.extend(r["i"] for p in source.parts("", at, step) for r in source.records(p))
            at = step
        return at

    at = drain(at)
    assert (seen, at) == ([0, 1, 2], ["p2", 1])
    bodies["p2"]["records"].append({"i": 3})
    at = drain(at)
    bodies["p2"] = {"records": [{"i": 2}, {"i": 3}, {"i": 4}], "next_cursor": 3}
    bodies["3"] = [{"i": 5}]
    assert drain(at) == ["3", 1]
    assert seen == [0, 1, 2, 3, 4, 5]
    assert [r["i"] for r in source.records(("", [None, 1], ["p2", 2]))] == [1, 2, 3]
    bodies[None]["status"] = "error"
    with pytest.raises(ValueError):
        source.step("", source.start(""))
    with pytest.raises(ValueError):
        page_stream.pages("ftp")


def test_nested_orders():
    orders = {("HA1", "7"): [{"order_id": 1, "add_time": "12", "shipping_status": 0}, {"order_id": 2, "add_time": 99, "shipping_status": 3}], ("HA2", "8"): [{"order_id": 3, "add_time": None}]}
    source = page_stream.OrderPages(
        lambda since: [{"referer": "HA1", "refer_count": "2"}, {"referer": "XX", "refer_count": 5}, {"referer": "HA2", "refer_count": 1}, {"referer": "HA3", "refer_count": 0}],
        lambda batch: [{"driver_id": 7 if batch == "HA1" else 8, "order_count": 1}, {"driver_id": None, "order_count": 1}, {"driver_id": 9, "order_count": 0}],
        lambda batch, driver: orders[batch, driver], since=5,
    )
    step = source.step("", source.start(""))
    assert step == [12, ["HA1", "HA2"]] and source.step("", step) is None
    rows = [r for p in source.parts("", [5, []], step) for r in source.records(p)]
    assert [(r["order_id"], r["batch_id"], r["driver_id"]) for r in rows] == [(1, "HA1", "7"), (3, "HA2", "8")]


def test_failed_requests_are_repeated():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("later")
        return x

    assert page_stream.retried(flaky, 1, wait=0.0) == 1 and len(calls) == 3
    with pytest.raises(OSError):
        page_stream.retried(lambda: (_ for _ in ()).throw(OSError()), wait=0.0)


def test_ingested_records_and_repeated_batches(spark, tmp_path):
    db = f"{tmp_path}/x.db"
    database(db, [(1, 9, "1 Oak Ave", "a"), (2, 10, " ", "a"), (3, 10, "3 Oak Ave", "a"), (1, 11, "1 Elm Lane", "a")])
    table = KeyedTable(spark, f"file://{tmp_path}/raw", KEYS, buckets=8)
    for k in range(2):  # the second stream knows nothing of the first and reads all again
        stream = page_stream.pages_stream(spark, "raws", keyset(db), pages_a_batch=9, wait=0.01)
        page_stream.ingest_stream(stream, table, "db", f"file://{tmp_path}/c{k}").awaitTermination()
        got = {r.external_id: (r.raw_address_text, r.source_cursor) for r in table.read().collect()}
        assert got == {"1": ("1 Elm Lane", "11"), "3": ("3 Oak Ave", "10")}
    assert '"address": "3 Oak Ave"' in table.read().where("external_id = '3'").first().source_payload


def test_largest_cursor_is_a_number(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a st", "9"), ("2", "b st", "10"), ("1", "c st", "10")], "id string, address string, updated_at string")
    table, settings = (upsert.VersionedTable(spark, f"file://{tmp_path}/{n}") for n in ("raw", "settings"))
    assert ingest.run_once(ingest.raw_records(rows, "api"), table, settings, "api") == "10" == ingest.cursor(settings, "api")
    assert {r.external_id: r.raw_address_text for r in table.read().collect()} == {"1": "c st", "2": "b st"}


def test_keyed_table_rewrites_what_it_touches(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k", "w"], buckets=50, rules={"c": upsert.COALESCE, "s": upsert.APPEND})
    kind = "k long, w string, v int, c string, s array<string>"
    old = spark.createDataFrame([(i, None if i % 7 == 0 else "w", i, f"c{i}", ["a"]) for i in range(1000)], kind)
    assert table.read() is None
    assert table.upsert(old) == list(range(50))
    new = spark.createDataFrame([(i, None if i % 7 == 0 else "w", -i, None, ["a", "b"]) for i in range(0, 1100, 110)], kind)
    touched = table.upsert(new, batch=("stream", 4))
    assert 1 <= len(touched) <= 10
    want = upsert.merge(old, new, ["k", "w"], table.rules)
    assert table.read().exceptAll(want).count() == 0 == want.exceptAll(table.read()).count()
    before = table.manifest()
    assert table.upsert(new.withColumn("v", F.lit(0)), batch=("stream", 4)) == [] and table.manifest() == before
    assert table.upsert(new.limit(0), batch=("stream", 5)) == [] and table.manifest()["batches"] == {"stream": 5}
    more = spark.createDataFrame([(1, "w", "x"), (5000, None, "y")], "k int, w string, extra string")  # a new column, and a key of a narrower type
    table.upsert(more)
    assert {(r.k, r.v, r.extra) for r in table.read().where("k IN (1, 2, 5000)").collect()} == {(1, 1, "x"), (2, 2, None), (5000, None, "y")}
    assert len(table._names("manifests")) == 2
    used = {f.split("/")[0] for n in table._names("manifests") for f in table._load(n)["buckets"].values()}
    assert set(table._names("data")) == used


def test_keyed_table_cut_off_before_its_commit(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=4)
    rows = spark.createDataFrame([(i, "a") for i in range(20)], "k long, v string")
    table.upsert(rows)
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.upsert(rows.withColumn("v", F.lit("b")))
    assert {r.v for r in table.read().collect()} == {"a"}
    table.upsert(rows.where("k < 3").withColumn("v", F.lit("c")))
    assert {(r.k, r.v) for r in table.read().collect()} == {(i, "c" if i < 3 else "a") for i in range(20)}
