"""Incremental ingestion and cleaning with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.decision import DecisionPolicy, validate
from waymark.operators.keyed_table import KeyedTable
from waymark.operators.upsert import COALESCE, VersionedTable, latest


def clean_batch(raw: DataFrame, references: DataFrame, published: DataFrame | None, policy: DecisionPolicy | None = None) -> DataFrame:
    """Results of the raw rows that aren't published yet, one for each (workspace_name, raw_id)."""
    fresh = latest(raw, ["workspace_name", "raw_id"])
    if published is not None:
        fresh = fresh.join(published.select("workspace_name", "raw_id"), ["workspace_name", "raw_id"], "left_anti")
    columns = ("workspace_name", "raw_id", "decision", "reason", "confidence", "building_type", "street_number", "street_name", "unit_number", "city", "province", "postal_code", "canonical_base_key", "canonical_full_key", "reference_external_id")
    return validate(fresh, references, policy).select(*columns).withColumn("status", F.lit("completed"))


def clean_stream(raw: DataFrame, references: DataFrame, table_path: str | KeyedTable, checkpoint: str, policy: DecisionPolicy | None = None, interval: str | None = None) -> StreamingQuery:
    """Cleans a stream of raw rows into a versioned table, or into a keyed one, of which a batch rewrites only its buckets; a batch that is run again finds its rows published and adds nothing.

    interval None drains what is there and ends; else batches are triggered at the interval and never overlap.
    """

    def publish(batch: DataFrame, _: int) -> None:
        keyed = isinstance(table_path, KeyedTable)
        table = table_path if keyed else VersionedTable(batch.sparkSession, table_path)
        published = table.rows_of(batch) if keyed and table.manifest() else table.read()
        table.upsert(clean_batch(batch, references, published, policy), ["workspace_name", "raw_id"], {"reason": COALESCE})

    writer = raw.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", length: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Events and their value by window and kind; late ones are waited for as long as lateness on a stream."""
    t = F.col(time).cast("timestamp")
    rows = events.withColumn("__t", t)
    if events.isStreaming:
        rows = rows.withWatermark("__t", lateness)
    out = rows.groupBy(F.window("__t", length), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), kind, "n", F.round("total", 4).alias("total"))
