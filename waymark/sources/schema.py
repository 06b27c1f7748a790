"""Catalog tables that grow by columns, and SQL scripts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

#: Control tables and their columns; ensure() adds to an older table what it lacks.
CONTROL = {
    "model_registry": "workspace_name string, model_name string, model_version string, status string, is_default boolean, default_profile string, artifact_path string, metrics_json string, created_at timestamp, updated_at timestamp",
    "active_learning_queue": "queue_id bigint, workspace_name string, source_name string, source_id string, task_type string, priority int, status string, reason string, confidence double, updated_at timestamp",
    "gold_label": "gold_label_id bigint, workspace_name string, source_name string, source_id string, task_type string, label_json string, review_status string, label_source string, score double, notes string",
    "control_setting": "workspace_name string, setting_key string, setting_value string, updated_at timestamp",
    "control_run": "run_id bigint, run_type string, status string, notes string, started_at timestamp, finished_at timestamp",
}


def ensure(spark: SparkSession, table: str, columns: str, location: str | None = None) -> list[str]:
    """Makes the table, or adds the columns it lacks; the names of the columns that were added. A column of another type is an error."""
    wanted = StructType.fromDDL(columns)
    if not spark.catalog.tableExists(table):
        at = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet{at}")
        return wanted.fieldNames()
    have = {f.name.lower(): f.dataType for f in spark.table(table).schema}
    for f in wanted:
        kind = have.get(f.name.lower())
        if kind is not None and kind != f.dataType:
            raise ValueError(f"{table}.{f.name} is {kind.simpleString()}, not {f.dataType.simpleString()}")
    new = [f for f in wanted if f.name.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    return [f.name for f in new]


def ensure_all(spark: SparkSession, tables: dict[str, str] | None = None, database: str = "default") -> dict[str, list[str]]:
    """ensure() for each table; what was added to each."""
    return {name: ensure(spark, f"{database}.{name}", columns) for name, columns in (tables or CONTROL).items()}


def statements(script: str) -> Iterator[str]:
    """The statements of a script: parted by semicolons outside quotes and comments; comments and empty statements are left out."""
    out, at, n = [], 0, len(script)
    while at < n:
        c, two = script[at], script[at : at + 2]
        if c in "'\"`":
            end = at + 1
            while end < n and script[end] != c:
                end += 2 if script[end] == "\\" and c != "`" else 1
            out.append(script[at : end + 1])
            at = end + 1
        elif two == "--":
            end = script.find("\n", at)
            at = n if end < 0 else end
        elif two == "/*":
            end = script.find("*/", at + 2)
            at = n if end < 0 else end + 2
            out.append(" ")
        elif c == ";":
            if text := "".join(out).strip():
                yield text
            out, at = [], at + 1
        else:
            out.append(c)
            at += 1
    if text := "".join(out).strip():
        yield text


def execute_script(spark: SparkSession, script: str) -> int:
    """Runs a script's statements in order; how many there were."""
    n = 0
    for text in statements(script):
        spark.sql(text)
        n += 1
    return n
