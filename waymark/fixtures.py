"""Address tables derived from the star-schema tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STREETS = "'Main St' WHEN 1 THEN 'Tower Road' WHEN 2 THEN 'Oak Ave' WHEN 3 THEN 'Elm Lane' WHEN 4 THEN 'Western Pkwy' WHEN 5 THEN 'Bedford Highway' ELSE 'Quingate Place' END"

RAW = f"""
SELECT 'default' AS workspace_name, o_orderkey AS raw_id, concat('src', CAST(o_custkey % 3 AS STRING)) AS source_name, concat('ord-', CAST(o_orderkey AS STRING)) AS external_id,
  CASE o_orderkey % 10 WHEN 0 THEN concat(n, ' ', st, ', ', c, ', ', p) WHEN 1 THEN concat(u, '-', n, ' ', st, ', ', c, ', ', p) WHEN 2 THEN concat(n, ' ', st, ' unit ', u, ' ', c, ' ', p)
    WHEN 3 THEN concat(n, ' ', st, ', ', u, ' ', c, ' ', p) WHEN 4 THEN concat('# ', u, ' ', n, ' ', st, ', ', c, ', ', p) WHEN 5 THEN concat('Suite ', u, ' ', n, ' ', st, ', ', c, ', ', p)
    WHEN 6 THEN concat('Level ', u, ' ', n, ' ', st, ', ', c, ', ', p) WHEN 7 THEN concat(n, ' ', st, ', ', u) WHEN 8 THEN concat('Rear ', n, ' ', st, ', ', c, ', ', p)
    ELSE concat('  ', n, '   ', lower(st), ' , ', c, ' ', p, '  ', pc, ' ') END AS raw_address_text,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c END AS city, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE p END AS province, CASE WHEN o_orderkey % 3 = 0 THEN pc ELSE NULL END AS postal_code, 'CA' AS country_code,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(44.6 AS DOUBLE) + CAST(o_custkey % 100 AS DOUBLE) / CAST(10000 AS DOUBLE) + CAST(o_orderkey % 4 AS DOUBLE) / CAST(2000 AS DOUBLE) END AS latitude,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(-63.6 AS DOUBLE) END AS longitude, o_orderdate AS source_cursor, o_orderkey % 17 <> 0 AS is_active
FROM (SELECT o_orderkey, o_custkey, o_orderdate, CAST(o_custkey % 100 + 1 AS STRING) AS n, CAST(o_orderkey % 40 + 1 AS STRING) AS u, CASE o_custkey % 7 WHEN 0 THEN {_STREETS} AS st,
    CASE o_custkey % 4 WHEN 0 THEN 'Halifax' WHEN 1 THEN 'Bedford' WHEN 2 THEN 'St. John''s' ELSE 'Rhodes Corner' END AS c, CASE o_custkey % 4 WHEN 2 THEN 'NL' ELSE 'NS' END AS p,
    concat('B', CAST(o_custkey % 10 AS STRING), 'J ', CAST(o_custkey % 7 AS STRING), 'K', CAST(o_custkey % 3 AS STRING)) AS pc FROM orders)
"""

REFERENCE = f"""
SELECT 'default' AS workspace_name, 'derived' AS source_name, c_custkey AS reference_id, concat('ref-', CAST(c_custkey AS STRING)) AS external_id, CAST(c_custkey % 100 + 1 AS STRING) AS street_number,
  upper(CASE c_custkey % 7 WHEN 0 THEN {_STREETS}) AS street_name, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 40 + 1 AS STRING) ELSE NULL END AS unit_number,
  CASE c_custkey % 4 WHEN 0 THEN 'Halifax' WHEN 1 THEN 'Bedford' WHEN 2 THEN 'St. John''S' ELSE 'Rhodes Corner' END AS city, CASE c_custkey % 4 WHEN 2 THEN 'NL' ELSE 'NS' END AS province,
  concat('B', CAST(c_custkey % 10 AS STRING), 'J ', CAST(c_custkey % 7 AS STRING), 'K', CAST(c_custkey % 3 AS STRING)) AS postal_code,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(44.6 AS DOUBLE) + CAST(c_custkey % 100 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS reference_lat, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(-63.6 AS DOUBLE) END AS reference_lon,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(0.82 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS quality_score, (c_custkey % 2 = 0 AND c_custkey % 3 <> 1) AS is_active FROM customer
"""

RESULT = """
SELECT 'default' AS workspace_name, o_orderkey AS raw_id, CASE o_custkey % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'review' WHEN 2 THEN 'reject' ELSE 'enrich' END AS decision,
  CASE o_orderkey % 3 WHEN 0 THEN 'single_unit' WHEN 1 THEN 'multi_unit' ELSE 'commercial' END AS building_type, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 40 + 1 AS STRING) END AS unit_number,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS confidence, CAST(o_custkey % 50 AS DOUBLE) / CAST(50 AS DOUBLE) AS reference_score,
  CASE o_orderkey % 4 WHEN 0 THEN 'simple_fallback' WHEN 1 THEN 'leading_hyphen' ELSE 'street_standard' END AS unit_source FROM orders
"""

GOLD = """
SELECT o_orderkey AS gold_label_id, 'default' AS workspace_name, 'raw' AS source_name, CASE WHEN o_orderkey % 40 = 0 THEN CAST(o_orderkey AS STRING) ELSE concat('ord-', CAST(o_orderkey AS STRING)) END AS source_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'building_type' ELSE 'unit_number' END AS task_type, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'review' ELSE 'correct' END AS gold_decision,
  CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'single_unit' WHEN 2 THEN 'commercial' ELSE 'multi_unit' END AS gold_building_type, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('# ', CAST(o_orderkey % 40 + 1 AS STRING)) END AS gold_unit_number,
  CASE WHEN o_orderkey % 7 = 0 THEN 'pending' ELSE 'accepted' END AS review_status, CASE WHEN o_custkey % 6 = 0 THEN 'model' ELSE 'human' END AS label_source FROM orders WHERE o_orderkey % 20 = 0
"""

JOB = """
SELECT event_id AS job_id, 'default' AS workspace_name, event_type AS job_kind, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'completed' END AS status,
  event_id % 3 AS priority, ts AS created_at, user_id, value, props FROM events
"""

MODEL = """
SELECT p_brand AS model_name, p_partkey AS version, p_size % 17 = 0 AS is_default, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 100 + p_partkey % 7 END AS promoted_at, p_partkey % 1000 AS created_at,
  CASE p_partkey % 3 WHEN 0 THEN 'evaluated' WHEN 1 THEN 'registered' ELSE 'deprecated' END AS status, p_retailprice AS score FROM part
"""

_KEPT = "'default' AS workspace_name, CASE WHEN raw_id % 97 = 0 THEN -raw_id ELSE raw_id END AS raw_id"

#: What a candidate and the active model say; a few rows have no result under their id.
CANDIDATE = f"""
SELECT {_KEPT}, CASE WHEN raw_id % 29 = 0 THEN 'review' ELSE decision END AS decision, building_type,
  CASE WHEN raw_id % 31 = 0 AND unit_number IS NOT NULL THEN concat('# ', unit_number) ELSE unit_number END AS unit_number, confidence
FROM ({RESULT}) r
"""

ACTIVE = f"""
SELECT 'default' AS workspace_name, raw_id, CASE WHEN raw_id % 37 = 0 THEN 'reject' ELSE decision END AS decision,
  CASE WHEN raw_id % 41 = 0 THEN 'commercial' ELSE building_type END AS building_type, unit_number, confidence
FROM ({RESULT}) r
"""

CASE = f"""
SELECT case_id, x_number, x_street, x_kind, x_unit, x_building, x_decision,
  concat('{{"street_number":"', x_number, '","street_name":"', x_street, '"', CASE x_kind WHEN 'absent' THEN '' WHEN 'null' THEN ',"unit_number":null' ELSE concat(',"unit_number":"# ', x_unit, '"') END,
    ',"building_type":"', x_building, '","decision":"', x_decision, '"}}') AS expected
FROM (SELECT o_orderkey AS case_id, CAST(o_custkey % 100 + 1 AS STRING) AS x_number, CASE o_custkey % 7 WHEN 0 THEN {_STREETS} AS x_street,
    CASE o_orderkey % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE 'given' END AS x_kind, CAST(o_orderkey % 40 + 1 AS STRING) AS x_unit,
    CASE o_orderkey % 3 WHEN 0 THEN 'single_unit' WHEN 1 THEN 'multi_unit' ELSE 'commercial' END AS x_building,
    CASE o_custkey % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'review' WHEN 2 THEN 'reject' ELSE 'enrich' END AS x_decision FROM orders)
"""

QUEUE = """
SELECT event_id AS queue_id, 'default' AS workspace_name, 'address_cleaning_result' AS source_name, CASE WHEN event_id % 50 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS source_id,
  event_type AS task_type, event_id % 3 AS priority, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'exported' WHEN 2 THEN 'labeled' WHEN 3 THEN 'queued' ELSE 'queued' END AS status FROM events
"""

EVALUATED = """
SELECT p_partkey AS model_id, concat('w', CAST(p_size % 5 AS STRING)) AS workspace_name, CASE p_partkey % 3 WHEN 0 THEN 'evaluated' WHEN 1 THEN 'registered' ELSE 'deprecated' END AS status,
  p_partkey % 1000 AS created_at, p_partkey % 997 AS updated_at, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice / CAST(1500 AS DOUBLE) END AS decision_f1,
  p_retailprice / CAST(1800 AS DOUBLE) AS metric_value, CAST(1 AS DOUBLE) AS building_type_f1, CAST(1 AS DOUBLE) AS unit_number_f1, CAST(0.9 AS DOUBLE) AS unit_recall, CAST(0.9 AS DOUBLE) AS commercial_f1,
  CAST(0.1 AS DOUBLE) AS review_rate, CAST(0.05 AS DOUBLE) AS reject_rate, CAST(0 AS DOUBLE) AS regression_risk, p_partkey % 2 AS replay_failures, CAST(100 AS BIGINT) AS processed_samples,
  p_partkey % 5 <> 0 AS promote_recommended, CAST(0 AS DOUBLE) AS shadow_advantage, CAST(0.05 AS DOUBLE) AS disagreement_rate FROM part
"""

_SOURCE = {"candidate": (CANDIDATE, "orders"), "active": (ACTIVE, "orders"), "cases": (CASE, "orders"), "queue": (QUEUE, "events"), "evaluated": (EVALUATED, "part")}
_SOURCE |= {"raw": (RAW, "orders"), "reference": (REFERENCE, "customer"), "result": (RESULT, "orders"), "gold": (GOLD, "orders"), "job": (JOB, "events"), "model": (MODEL, "part")}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """raw, reference, result, gold, job, model, candidate, active, cases, queue or evaluated, derived from the table in sf_dir."""
    sql, table = _SOURCE[name]
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(sql.replace(f"FROM {table}", "FROM {" + table + "}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def ctes(*names: str) -> str:
    """The same as common table expressions."""
    return ", ".join(f"{n} AS ({_SOURCE[n][0]})" for n in names)
