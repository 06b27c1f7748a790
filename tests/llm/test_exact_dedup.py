import hashlib

import pytest

from pyspark.sql import functions as F

from waymark.llm import exact_dedup, key_filter

ODD = [None, "", " ", "\n", "a", "A", "a ", "é", "é", "x" * 300_000, "x" * 300_000 + "y", "same", "same", "same", None, "x" * 300_000]


def brute(rows):
    """keep_id, group_size and the number of kept rows of each text, from rows (doc_id, text)."""
    out = {}
    for i, t in rows:
        best, n = out.get(t or "", (None, 0))
        out[t or ""] = (i if best is None or (i is not None and i > best) else best, n + 1)
    return out


def compare(found, rows):
    want = brute(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in found.collect()]
    assert sorted(((r[0] is not None, r[0] or 0) for r in got)) == sorted(((i is not None, i or 0) for i, _ in rows))
    for doc_id, keep, n, _, digest in got:
        if len(digest) == 64:
            assert (keep, n) == by_digest[digest]
    assert sum(r[3] for r in got) == len(want)
    assert all(r[0] == r[1] for r in got if r[3])
    by_id = {i: want[t or ""] for i, t in rows}
    if len(by_id) == len(rows):
        assert {r[0]: (r[1], r[2]) for r in got} == by_id


@pytest.fixture
def land(spark, tmp_path):
    def put(name, rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("run", F.lit(None).cast("string"))
        df.repartition(2).write.mode("append").parquet(f"file://{tmp_path}/land/{name}")

    return put


def test_runs_add_up(spark, tmp_path, land):
    first = list(enumerate(ODD))
    source, dedup = f"file://{tmp_path}/land/*", exact_dedup.StreamingDedup(spark, f"file://{tmp_path}/d")
    land("a", first)
    dedup.ingest(source)
    compare(dedup.members(source), first)
    second = [(100 + i, t) for i, t in enumerate(["same", "new", None, "x" * 300_000, "new"])]
    land("b", second)
    dedup.ingest(source, files_per_batch=1)
    dedup.ingest(source)  # nothing new
    compare(dedup.members(source), first + second)
    assert dedup.collisions().isEmpty()


def test_cut_off_run_is_taken_up(spark, tmp_path, land, monkeypatch):
    rows = list(enumerate(ODD))
    source, dedup = f"file://{tmp_path}/land/*", exact_dedup.StreamingDedup(spark, f"file://{tmp_path}/d", lambda t: F.substring(exact_dedup.sha256(t), 1, 0))
    land("a", rows)
    with monkeypatch.context() as m:
        m.setattr(dedup, "_check", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            dedup.ingest(source)
    dedup.ingest(source)
    assert dedup.collisions().count() == 1  # all texts have the same digest; the bytes tell
    compare(dedup.members(source), rows)


def test_collisions_of_a_short_digest(spark, tmp_path, land):
    rows = [(i, f"text {i % 40}") for i in range(100)]
    source = f"file://{tmp_path}/land/*"
    dedup = exact_dedup.StreamingDedup(spark, f"file://{tmp_path}/d", lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 2)))
    land("a", rows[:50])
    dedup.ingest(source)
    land("b", rows[50:])
    dedup.ingest(source)
    assert not dedup.collisions().isEmpty()
    compare(dedup.members(source), rows)


def test_empty_table_and_repeated_ids(spark, tmp_path, land):
    source, dedup = f"file://{tmp_path}/land/*", exact_dedup.StreamingDedup(spark, f"file://{tmp_path}/d")
    land("a", [])
    dedup.ingest(source)
    assert dedup.members(source).count() == 0
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (None, "c"), (-5, None), (-7, "")]
    land("b", rows)
    dedup.ingest(source)
    compare(dedup.members(source), rows)


def test_filter_loses_no_key(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    found = {r.id for r in key_filter.passing(spark.range(30_000), F.xxhash64("id"), keys).collect()}
    assert set(range(0, 3000, 3)) <= found and len(found) < 1000 + 0.06 * 30_000
    assert key_filter.passing(spark.range(5), F.xxhash64("id"), keys.limit(0)).count() == 0
    assert [key_filter.bits_for(n) for n in (0, 1, 1024, 1025, 10**12)] == [1 << 15, 1 << 15, 1 << 15, 1 << 16, key_filter.MAX_BITS]
