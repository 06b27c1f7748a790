"""Import of raw address records: alias coalescing, incremental scans, API pages, exports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from waymark.functions import scalars as s

# Which columns may carry a field, the first that is filled wins.
ALIASES = {
    "external_id": ("external_id", "order_id", "id", "record_id"),
    "raw_address_text": ("raw_address_text", "delivery_address", "address_text", "address"),
    "city": ("city", "COMM", "municipality"),
    "province": ("province", "PROVINCE", "state"),
    "postal_code": ("postal_code", "postcode", "zip", "zipcode"),
    "country_code": ("country_code", "country"),
    "latitude": ("latitude", "lat", "gps_lat", "gps.lat", "LAT"),
    "longitude": ("longitude", "lon", "lng", "gps_lon", "gps.lon", "LONG"),
    "source_cursor": ("source_cursor", "updated_at", "created_at"),
}


def _found(df: DataFrame, name: str, nested: str | None) -> Column | None:
    """The column called name; a dotted name is looked up in the struct or JSON column before the dot; any name else in the JSON column nested."""
    if name in df.columns:
        return F.col(f"`{name}`")
    first, _, rest = name.partition(".")
    if rest and first in df.columns:
        kind = dict(df.dtypes)[first]
        fields = df.schema[first].dataType.fieldNames() if kind.startswith("struct") else ()
        return F.col(name) if rest in fields else s.dig(f"`{first}`", rest) if kind == "string" else None
    return s.dig(nested, name) if nested else None


def picked(df: DataFrame, names: tuple[str, ...], nested: str | None = None) -> Column:
    """The first filled value among columns (see _found)."""
    have = [s.filled(F.trim(c.cast("string"))) for c in (_found(df, n, nested) for n in names) if c is not None]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def raw_records(df: DataFrame, source_name: str, workspace: str = "default", mapping: dict[str, str] | None = None, nested: str | None = None) -> DataFrame:
    """Raw address rows from any table; rows without id or text are dropped. mapping names a field's column, before the aliases."""
    field = {k: picked(df, ((mapping[k],) if mapping and k in mapping else ()) + v, nested) for k, v in ALIASES.items()}
    payload = F.col(nested) if nested and df.columns == [nested] else F.to_json(F.struct("*"))
    out = df.select(
        F.lit(workspace).alias("workspace_name"), F.lit(source_name).alias("source_name"), field["external_id"].alias("external_id"), field["raw_address_text"].alias("raw_address_text"),
        *[field[k].alias(k) for k in ("city", "province", "postal_code")], F.coalesce(field["country_code"], F.lit("CA")).alias("country_code"),
        *[field[k].try_cast("double").alias(k) for k in ("latitude", "longitude")], field["source_cursor"].alias("source_cursor"), payload.alias("source_payload"), F.lit(True).alias("is_active"),
    )
    return out.where("external_id IS NOT NULL AND raw_address_text IS NOT NULL")


def split_invalid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others for a side output."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns strings."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def import_csv(spark: SparkSession, path: str, table, source_name: str, workspace: str = "default") -> tuple[int, int]:
    """Upserts a CSV's records into a versioned table by workspace, source and external id; rows seen and rows ingested. A later row of the file wins."""
    seen = Observation("csv")
    rows = read_csv(spark, path).observe(seen, F.count(F.lit(1)).alias("n"))
    records = raw_records(rows, source_name, workspace)
    ingested = Observation("records")
    table.upsert(records.observe(ingested, F.count(F.lit(1)).alias("n")), ["workspace_name", "source_name", "external_id"])
    return seen.get["n"], ingested.get["n"]


def cursor_order(cursor: Column) -> Column:
    """Cursors in their order: numbers as numbers, above others; texts (such as times) as texts."""
    return F.struct(cursor.try_cast("double").alias("number"), cursor.alias("text"))


def run_once(records: DataFrame, table, settings, key: str) -> str | None:
    """One ingestion run: upserts records (of raw_records()), then stores and returns the largest source_cursor as setting key; without rows the cursor stays.

    The largest cursor is observed while the records are written, so they are read once.
    """
    if records.isEmpty():
        return None
    seen = Observation("cursor")
    order = cursor_order(F.col("source_cursor"))
    observed = records.withColumn("__order", order).observe(seen, F.max(order).alias("last"))
    table.upsert(observed, ["workspace_name", "source_name", "external_id"], order="__order")
    last = (seen.get["last"] or {"text": None})["text"]
    if last is not None:
        settings.upsert(records.sparkSession.createDataFrame([(key, last)], "setting_key string, setting_value string"), ["setting_key"])
    return last


def cursor(settings, key: str) -> str | None:
    df = settings.read()
    row = None if df is None else df.where(F.col("setting_key") == key).select("setting_value").first()
    return row[0] if row else None


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from JSON lines: case_id (hash of the line), raw_address_text, city, province, postal_code, profile and expected (JSON text)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    names = ("raw_address_text", "city", "province", "postal_code", "profile", "expected")
    return lines.select(F.xxhash64("value").alias("case_id"), *[F.get_json_object("value", f"$.{n}").alias(n) for n in names])


def read_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """Parser weights from a model's JSON artifact (decision_policy.parser_weights); {} if there are none."""
    from waymark.operators.models import model_of, read_artifact

    return dict(model_of(read_artifact(spark, path), "").policy.parser_weights)


def page(df: DataFrame, cursor: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """The next rows after (cursor, key); the key as a second part of the cursor keeps rows of equal cursors at a page's edge."""
    if after is not None:
        at, last = after
        df = df.where((F.col(cursor) > F.lit(at)) | ((F.col(cursor) == F.lit(at)) & (F.col(key) > F.lit(last))))
    return df.orderBy(cursor, key).limit(size)


def start_time(cursor: Column, now: Column, lookback_seconds: int = 604800) -> Column:
    return F.coalesce(cursor.try_cast("bigint"), F.unix_timestamp(now) - lookback_seconds)


def nested_orders(batches: DataFrame, drivers: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders of the batches of a delivery API, filtered as its three nested requests do, and the largest add_time."""
    b = batches.where(F.col("referer").startswith("HA") & (F.col("refer_count") > 0))
    d = drivers.where("order_count > 0")
    o = orders.where(F.col("shipping_status").isNull() | (F.col("shipping_status").cast("string") == "0"))
    rows = o.join(d.select("driver_id", "batch_id"), ["driver_id", "batch_id"]).join(b.select("batch_id"), "batch_id")
    return rows, rows.agg(F.max("add_time").alias("next_cursor"))


def page_of(body, data_path: str = "data", cursor_path: str = "next_cursor", more_path: str = "has_more", status: str | None = None) -> tuple[list[dict], str | None, bool]:
    """Records, next cursor and whether there is more, of a decoded body: a list, or an object with these at dotted paths or under their usual names.

    status: what the body's own status must be, where it has one. Records that are no objects are left out.
    """

    def at(path, *names):
        value = body
        for part in path.split(".") if path else ():
            value = value.get(part) if isinstance(value, dict) else None
        return next((v for v in (value if path else None, *(body.get(n) for n in names)) if v not in (None, "")), None)

    if isinstance(body, list):
        return [r for r in body if isinstance(r, dict)], None, False
    if status is not None and body.get("status") not in (status, None):
        raise ValueError(f"unexpected status of a page: {body.get('status')}")
    following = at(cursor_path, "next_cursor", "cursor")
    rows = at(data_path, "records", "data") or []
    return [r for r in rows if isinstance(r, dict)], None if following is None else str(following), bool(at(more_path, "has_more", "more"))


def pages_of(fetch: Callable[[str | None], dict], data_path: str = "data", cursor_path: str = "next_cursor", more_path: str = "has_more", cursor: str | None = None, retries: int = 3, wait: float = 1.0) -> Iterator[list[dict]]:
    """Pages of an API by its cursor; fetch(cursor) returns a decoded body."""
    while True:
        for k in range(retries):
            try:
                rows, new, more = page_of(fetch(cursor), data_path, cursor_path, more_path)
                break
            except OSError:
                if k == retries - 1:
                    raise
                time.sleep(wait * (k + 1))
        if rows:
            yield rows
        if not rows or new in (None, cursor) or not more:
            return
        cursor = new


def read_jdbc(spark: SparkSession, url: str, table: str, cursor: str, after: str | None = None, partitions: int = 16, bounds: tuple | None = None, **options: str) -> DataFrame:
    """A table behind JDBC; the cursor predicate is pushed down, and bounds deal the scan out."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds:
        reader = reader.options(partitionColumn=cursor, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    df = reader.load()
    return df if after is None else df.where(F.col(cursor) > F.lit(after))


def export_snapshot(tables: dict[str, tuple[DataFrame, str]], path: str, workspace: str = "default") -> DataFrame:
    """Writes each table's rows of a workspace as CSV in key order, and a manifest of row counts (name, n_rows)."""
    counts = []
    spark = None
    for name, (df, key) in tables.items():
        spark = df.sparkSession
        rows = df.where(F.col("workspace_name") == workspace)
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in rows.dtypes]
        written = Observation(name)
        ordered = rows.repartitionByRange(key).sortWithinPartitions(key).select(*flat)
        ordered.observe(written, F.count(F.lit(1)).alias("n")).write.option("header", True).csv(f"{path}/{name}")
        counts.append((name, written.get["n"]))
    manifest = spark.createDataFrame(counts, "name string, n_rows long")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


def list_exports(spark: SparkSession, root: str) -> DataFrame:
    """The manifests under root, newest path first."""
    return spark.read.json(f"{root}/*/manifest").withColumn("path", F.input_file_name()).orderBy(F.col("path").desc())
