"""Queries of evaluation, replay, shadow and release over the derived address tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.fixtures import RAW, ctes, derived
from waymark.operators import evaluate, label_json, labels, models, release
from waymark.operators.candidates import DEFAULT_PARSERS
from waymark.operators.models import Model, model_of
from waymark.operators.parsers import spread
from waymark.operators.reference import match_reference
from waymark.queries import _COMPARE, _MATCH, _PRESCREEN, _RATES, _VALID, _models, _query, _street, _swapped, _title, _unit, _validated

_DEFAULTS = "coalesce(d, '') AS d, coalesce(b, '') AS b, coalesce(u, '') AS u"
_NORMAL = f"""SELECT raw_id, coalesce(CASE WHEN lower(trim(decision)) = 'correct' THEN 'accept' ELSE nullif(trim(decision), '') END, '') AS d,
  coalesce(nullif(trim(building_type), ''), '') AS b, coalesce({_unit("nullif(trim(unit_number), '')")}, '') AS u"""


_PLAIN = "SELECT raw_id, decision AS d, building_type AS b, unit_number AS u"


def _runs(limit: int, where: str, value: str = _NORMAL) -> str:
    """ok: the newest rows with what is current (k), the candidate (c) and the active model (a) say."""
    return f"""nk AS ({value} FROM result), nc AS ({value} FROM candidate), na AS ({value} FROM active), {_flags(limit, where)}"""


def _filled(x: str) -> str:
    return f"(coalesce({x}d, ''), coalesce({x}b, ''), coalesce({x}u, ''))"


def _flags(limit: int, where: str) -> str:
    return f"""
rws AS (SELECT raw_id, raw_address_text FROM raw {where} ORDER BY raw_id DESC LIMIT {limit}),
jn AS (SELECT rws.*, nc.raw_id IS NULL OR na.raw_id IS NULL AS failed, nk.raw_id IS NOT NULL AS known, nk.d AS kd, nk.b AS kb, nk.u AS ku, nc.d AS cd, nc.b AS cb, nc.u AS cu, na.d AS ad, na.b AS ab, na.u AS au
  FROM rws LEFT JOIN nk USING (raw_id) LEFT JOIN nc USING (raw_id) LEFT JOIN na USING (raw_id)),
ok AS (SELECT *, cd IS DISTINCT FROM ad OR cb IS DISTINCT FROM ab OR cu IS DISTINCT FROM au AS different, {_filled('c')} = {_filled('k')} AS ck, {_filled('a')} = {_filled('k')} AS ak FROM jn WHERE NOT failed)"""


def _share(c: str) -> str:
    return f"round(coalesce(count(*) FILTER ({c}) / nullif(count(*), 0), 0), 4)"


_FIXTURES = ctes("raw", "result", "candidate", "active")


def _four(spark, d):
    return [derived(spark, d, n) for n in ("raw", "result", "candidate", "active")]


_REPLAYED = f"""SELECT (SELECT count(*) FROM jn) AS total_samples, (SELECT count(*) FROM jn WHERE failed) AS failures, count(*) AS processed, count(*) FILTER (different) AS mismatches,
  {_share("coalesce(cd, '') = coalesce(ad, '')")} AS decision_match_rate, {_share("coalesce(cb, '') = coalesce(ab, '')")} AS building_type_match_rate, {_share("coalesce(cu, '') = coalesce(au, '')")} AS unit_number_match_rate,
  {_share('ak')} AS active_current_match_rate, {_share('ck')} AS candidate_current_match_rate, {_share('different')} AS disagreement_rate, {_share('NOT different')} AS consistency_score
FROM ok"""


@_query("historical_replay", f"WITH {_FIXTURES}, {_runs(2000, 'WHERE is_active', _PLAIN)} {_REPLAYED}")
def _replay_run(spark, d):
    return release.replay_run(*_four(spark, d))


@_query("mismatch_samples", f"""WITH {_FIXTURES}, {_runs(2000, 'WHERE is_active', _PLAIN)}
SELECT raw_id, raw_address_text, ad AS a_decision, cd AS c_decision, ab AS a_building_type, cb AS c_building_type, au AS a_unit_number, cu AS c_unit_number
FROM ok WHERE different ORDER BY raw_id DESC LIMIT 50""")
def _mismatches(spark, d):
    return release.mismatch_samples(*_four(spark, d))


_SHADOWED = f"""s AS (SELECT count(*) AS compared, {_share('ck')} AS candidate_match_rate, {_share('ak')} AS active_match_rate, {_share('different')} AS disagreement_rate FROM ok),
t AS (SELECT *, round(candidate_match_rate - active_match_rate, 4) AS shadow_advantage, CAST(0 AS DOUBLE) AS score_delta FROM s),
p AS (SELECT *, compared >= 50 AND score_delta >= 0 AND shadow_advantage >= 0 AND disagreement_rate <= CAST(0.10 AS DOUBLE) AS promote_recommended FROM t)
SELECT *, CASE WHEN promote_recommended THEN 'promote_candidate' ELSE 'keep_active' END AS decision FROM p"""


@_query("shadow_run", f"WITH {_FIXTURES}, {_runs(500, '')}, {_SHADOWED}")
def _shadow(spark, d):
    return release.shadow_run(*_four(spark, d))


#: An active model and a candidate, as their artifacts have them.
ACTIVE_MODEL = model_of({"parsers": ["simple_rule", "hybrid_canada", "libpostal"], "decision_policy": {"parser_weights": {"hybrid_canada": 0.5, "libpostal": 0.2}}}, "a")
CANDIDATE_MODEL = model_of({"parsers": ["simple_rule", "hybrid_canada"], "decision_policy": {"high_confidence_accept_threshold": 0.7, "moderate_confidence_review_threshold": 0.3, "close_candidate_delta": 0.4, "parser_weights": {"simple_rule": 0.9}}}, "c")
_WEIGHTS = ACTIVE_MODEL.policy.parser_weights


def _model_runs(limit: int, where: str, value: str) -> str:
    """ok: the newest rows with what both models say of them, without positions, and what is current."""
    seen = f"raw AS (SELECT * REPLACE (NULL::DOUBLE AS latitude, NULL::DOUBLE AS longitude, 'CA' AS country_code) FROM rows0 {where} ORDER BY raw_id DESC LIMIT {limit})"
    own = lambda m: f"{value} FROM (SELECT raw_id, decision, building_type, suggested_unit AS unit_number FROM v WHERE model = '{m}')"
    tables = f"{ctes('reference', 'result')}, rows0 AS ({RAW}), {seen}, {_models([CANDIDATE_MODEL, ACTIVE_MODEL], _WEIGHTS)}"
    return f"{tables}, nk AS ({value} FROM result), nc AS ({own('c')}), na AS ({own('a')}), {_flags(limit, '')}"


def _model_tables(spark, d):
    return [derived(spark, d, n) for n in ("raw", "reference", "result")] + [CANDIDATE_MODEL, ACTIVE_MODEL]


@_query("model_replay", f"WITH {_model_runs(2000, 'WHERE is_active', _PLAIN)} {_REPLAYED}")
def _model_replay(spark, d):
    """Both models run on the newest active rows, in one plan."""
    return release.replay_counts(release.replay_models(*_model_tables(spark, d)))


@_query("model_replay_rows", f"WITH {_model_runs(2000, 'WHERE is_active', _PLAIN)} SELECT raw_id, cd AS c_decision, ad AS a_decision, cb AS c_building_type, ab AS a_building_type, cu AS c_unit_number, au AS a_unit_number, kd AS k_decision, different FROM ok")
def _model_replay_rows(spark, d):
    rows = release.replay_models(*_model_tables(spark, d))
    return rows.select("raw_id", *[f"{x}_{f}" for f in release.FIELDS for x in ("c", "a")], "k_decision", "different")


@_query("model_shadow", f"WITH {_model_runs(500, '', _NORMAL)}, {_SHADOWED}")
def _model_shadow(spark, d):
    return release.shadow_counts(release.shadow_models(*_model_tables(spark, d)))


_CASES = f"""{_VALID}, bm AS (
SELECT case_id, 1 AS k, 'street_number' AS field, x_number AS expected, street_number AS predicted FROM cases JOIN v ON case_id = raw_id
UNION ALL SELECT case_id, 2, 'street_name', upper(x_street), street_name FROM cases JOIN v ON case_id = raw_id
UNION ALL SELECT case_id, 3, 'unit_number', CASE WHEN x_kind = 'given' THEN x_unit END, unit_number FROM cases JOIN v ON case_id = raw_id WHERE x_kind <> 'absent'
UNION ALL SELECT case_id, 4, 'building_type', x_building, building_type FROM cases JOIN v ON case_id = raw_id
UNION ALL SELECT case_id, 5, 'decision', x_decision, decision FROM cases JOIN v ON case_id = raw_id)"""


def _cases(spark, d):
    return derived(spark, d, "cases"), _validated(spark, d).withColumnRenamed("raw_id", "case_id")


@_query("golden_benchmark", f"""WITH {ctes('raw', 'reference', 'cases')}, {_CASES}
SELECT field, count(*) AS total, count(*) FILTER (expected IS NOT DISTINCT FROM predicted) AS matched, {_share('expected IS NOT DISTINCT FROM predicted')} AS accuracy FROM bm GROUP BY field""")
def _benchmark(spark, d):
    return evaluate.benchmark_report(*_cases(spark, d))


@_query("golden_failures", f"""WITH {ctes('raw', 'reference', 'cases')}, {_CASES}
SELECT case_id, field, expected, predicted FROM bm WHERE expected IS DISTINCT FROM predicted ORDER BY case_id, k LIMIT 50""")
def _failures(spark, d):
    return evaluate.benchmark_failures(*_cases(spark, d))


_ALONE = [Model(p, parsers=(p,)) for p in DEFAULT_PARSERS]
_BY_PARSER = f"""{_models(_ALONE)}, bm AS (
SELECT model, 'street_number' AS field, x_number AS expected, street_number AS predicted FROM cases JOIN v ON case_id = raw_id
UNION ALL SELECT model, 'street_name', upper(x_street), street_name FROM cases JOIN v ON case_id = raw_id
UNION ALL SELECT model, 'unit_number', CASE WHEN x_kind = 'given' THEN x_unit END, unit_number FROM cases JOIN v ON case_id = raw_id WHERE x_kind <> 'absent'
UNION ALL SELECT model, 'building_type', x_building, building_type FROM cases JOIN v ON case_id = raw_id
UNION ALL SELECT model, 'decision', x_decision, decision FROM cases JOIN v ON case_id = raw_id),
acc AS (SELECT model AS parser_name, field, count(*) AS total, count(*) FILTER (expected IS NOT DISTINCT FROM predicted) AS matched, {_share('expected IS NOT DISTINCT FROM predicted')} AS accuracy FROM bm GROUP BY model, field)"""


def _golden(spark, d):
    return derived(spark, d, "cases"), spread(derived(spark, d, "raw")), derived(spark, d, "reference")


@_query("parsers_alone", f"WITH {ctes('raw', 'reference', 'cases')}, {_BY_PARSER} SELECT * FROM acc")
def _alone(spark, d):
    """Each parser alone on the golden cases, from one parse."""
    return models.parsers_alone(*_golden(spark, d))


@_query("parser_weights", f"""WITH {ctes('raw', 'reference', 'cases')}, {_BY_PARSER}, s AS (SELECT parser_name, round(sum(accuracy) / 5, 4) AS score FROM acc GROUP BY parser_name)
SELECT *, round(CASE WHEN sum(score) OVER () > 0 THEN score / sum(score) OVER () ELSE 1 / count(*) OVER () END, 4) AS weight FROM s""")
def _weights(spark, d):
    return models.learned_weights(*_golden(spark, d))


_DISTRIBUTION = ", ".join(f"{_share(f"decision = '{x}'")} AS {x}_rate" for x in ("accept", "review", "reject"))


@_query("release_benchmark", f"""WITH {ctes('gold', 'raw', 'result')}, {_COMPARE},
k AS (SELECT field, count(g) AS total, count(*) FILTER (g = p) AS tp, count(*) FILTER (g <> p) AS fp, count(*) FILTER (g IS NOT NULL AND g IS DISTINCT FROM p) AS fn FROM lng GROUP BY field
  UNION ALL SELECT 'commercial', count(*), count(*) FILTER (g = 'commercial' AND p = 'commercial'), count(*) FILTER (g <> 'commercial' AND p = 'commercial'), count(*) FILTER (g = 'commercial' AND p IS DISTINCT FROM 'commercial')
    FROM lng WHERE field = 'building_type' AND g IS NOT NULL),
m AS (SELECT field, {_RATES} FROM k), f AS (SELECT field, recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 4) AS f1 FROM m),
o AS (SELECT max(f1) FILTER (field = 'decision') AS decision_f1, max(f1) FILTER (field = 'building_type') AS building_type_f1, max(f1) FILTER (field = 'unit_number') AS unit_number_f1,
  max(recall) FILTER (field = 'unit_number') AS unit_recall, max(f1) FILTER (field = 'commercial') AS commercial_f1 FROM f)
SELECT o.*, c.* FROM o, (SELECT {_DISTRIBUTION} FROM result) c""")
def _release(spark, d):
    gold, raw, result = (derived(spark, d, n) for n in ("gold", "raw", "result"))
    return release.release_benchmark(evaluate.gold_compare(gold, raw, result), result)


_CHECKS = (("decision_f1", ">="), ("building_type_f1", ">="), ("unit_number_f1", ">="), ("unit_recall", ">="), ("commercial_f1", ">="), ("review_rate", "<="), ("reject_rate", "<="))


@_query("compare_release", f"""WITH {ctes('evaluated')}, x AS ({" UNION ALL ".join(
    f"SELECT c.model_id, '{m}' AS metric, coalesce(c.{m}, 0) AS candidate, CASE WHEN a.model_id IS NOT NULL THEN coalesce(a.{m}, 0) END AS active, a.model_id IS NULL OR coalesce(c.{m}, 0) {o} coalesce(a.{m}, 0) AS passed "
    "FROM evaluated c LEFT JOIN (SELECT model_id + 1 AS model_id, * EXCLUDE (model_id) FROM evaluated WHERE status <> 'registered') a ON c.model_id = a.model_id" for m, o in _CHECKS)})
SELECT *, round(candidate - active, 4) AS delta FROM x""")
def _compare(spark, d):
    """Each model against the one registered before it."""
    models = derived(spark, d, "evaluated")
    before = models.where("status <> 'registered'").withColumn("model_id", F.col("model_id") + 1)
    return evaluate.compare_release(models, before, "model_id").select("model_id", "metric", "candidate", "active", "passed", "delta")


@_query("release_readiness", f"""WITH {ctes('evaluated')}, l AS (SELECT *, row_number() OVER (PARTITION BY workspace_name ORDER BY created_at DESC, model_id DESC) AS k FROM evaluated WHERE status = 'evaluated')
SELECT workspace_name, model_id, coalesce(decision_f1 >= CAST(0.90 AS DOUBLE) AND building_type_f1 >= CAST(0.85 AS DOUBLE) AND unit_number_f1 >= CAST(0.85 AS DOUBLE) AND unit_recall >= CAST(0.85 AS DOUBLE)
  AND commercial_f1 >= CAST(0.85 AS DOUBLE) AND review_rate <= CAST(0.35 AS DOUBLE) AND reject_rate <= CAST(0.10 AS DOUBLE) AND regression_risk <= CAST(0.02 AS DOUBLE) AND replay_failures = 0
  AND promote_recommended AND shadow_advantage >= 0 AND disagreement_rate <= CAST(0.10 AS DOUBLE), false) AS ready
FROM l WHERE k = 1""")
def _readiness(spark, d):
    return release.release_readiness(derived(spark, d, "evaluated")).select("workspace_name", "model_id", "ready")


@_query("accuracy_trend", f"""WITH {ctes('evaluated')}, l AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, model_id DESC) AS k FROM evaluated WHERE status = 'evaluated')
SELECT CAST(max(k) OVER () - k AS INTEGER) AS position, coalesce(nullif(decision_f1, 0), metric_value, 0) AS value FROM l WHERE k <= 3""")
def _trend(spark, d):
    return release.accuracy_trend(derived(spark, d, "evaluated"))


_FEATURES = f"""{_VALID}, lab AS (SELECT *, CASE gold_label_id % 3 WHEN 0 THEN 'Main St' WHEN 1 THEN NULL ELSE 'Oak  Ave' END AS gold_street_name FROM gold),
f AS (SELECT g.gold_label_id, coalesce(nullif(trim(parser_name), ''), 'unknown') AS unit_source, length(raw_address_text) AS text_length, coalesce(confidence, 0) AS system_confidence,
  CASE WHEN length(coalesce(raw.postal_code, '')) >= 3 THEN upper(raw.postal_code[1:3]) ELSE 'UNK' END AS fsa_prefix, 0 AS has_unit_keyword, 0 AS is_commercial_hit, 0 AS llm_was_involved,
  CAST(lower(coalesce(decision, '')) = lower(coalesce(gold_decision, '')) AND lower(coalesce(building_type, '')) = lower(coalesce(gold_building_type, ''))
    AND {_unit('suggested_unit')} IS NOT DISTINCT FROM {_unit('gold_unit_number')} AND (gold_street_name IS NULL OR street_name IS NOT DISTINCT FROM {_street('gold_street_name')}) AS INTEGER) AS target_is_correct
  FROM lab g JOIN (SELECT * EXCLUDE (raw_address_text) FROM v) r ON g.workspace_name = r.workspace_name AND CAST(r.raw_id AS VARCHAR) = g.source_id JOIN raw ON raw.raw_id = r.raw_id WHERE review_status = 'accepted')"""


def _training(spark, d):
    """Labels against what the parsers and the ladder really say of the rows."""
    street = F.when(F.col("gold_label_id") % 3 == 0, "Main St").when(F.col("gold_label_id") % 3 == 2, "Oak  Ave")
    results = _validated(spark, d).drop("raw_address_text", "postal_code").withColumns({"unit_number": F.col("suggested_unit"), "regex_hit": F.lit(0), "is_commercial": F.lit(0), "llm_involved": F.lit(0)})
    return release.training_features(derived(spark, d, "gold").withColumn("gold_street_name", street), results, derived(spark, d, "raw"))


@_query("training_features", f"WITH {ctes('gold', 'raw', 'reference')}, {_FEATURES} SELECT * FROM f")
def _features(spark, d):
    return _training(spark, d)


@_query("reranking_weights", f"WITH {ctes('gold', 'raw', 'reference')}, {_FEATURES} SELECT unit_source, round(avg(target_is_correct), 4) AS precision, count(*) AS n FROM f GROUP BY unit_source")
def _reranking(spark, d):
    return evaluate.reranking_weights(_training(spark, d))


@_query("batch_prescreen", f"""WITH {ctes('raw', 'result', 'queue')}, q AS (SELECT *, CAST(queue_id % 100 AS DOUBLE) / 100 AS confidence FROM queue WHERE status = 'queued' ORDER BY priority DESC, source_id, task_type, queue_id LIMIT 200),
c AS (SELECT DISTINCT source_id, task_type FROM queue WHERE status = 'labeled'), r AS (SELECT raw_id, building_type FROM result),
o AS (SELECT CASE WHEN q.source_id = '' THEN 'skipped' WHEN c.source_id IS NOT NULL THEN 'cached'
    WHEN coalesce(raw_address_text, '') <> '' AND (q.task_type IN ('unit_number', 'building_type') OR {_PRESCREEN}) THEN 'processed' ELSE 'skipped' END AS outcome
  FROM q LEFT JOIN c ON q.source_id = c.source_id AND q.task_type = c.task_type LEFT JOIN raw ON CAST(raw.raw_id AS VARCHAR) = q.source_id LEFT JOIN r ON r.raw_id = raw.raw_id)
SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def _batch(spark, d):
    queue = derived(spark, d, "queue").withColumn("confidence", (F.col("queue_id") % 100).cast("double") / 100)
    details = derived(spark, d, "raw").join(derived(spark, d, "result").select("raw_id", "building_type"), "raw_id").withColumn("source_id", F.col("raw_id").cast("string"))
    out = labels.batch_prescreen(queue, details, queue.where("status = 'labeled'"))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- labels as JSON, reviews, errors from stored metrics, several localities ----

_JSON = """CASE gold_label_id % 7 WHEN 0 THEN concat('{"decision": "', gold_decision, '", "structure_type": "commercial", "building_type": "", "canonical": {"unit_number": "# ', CAST(gold_label_id % 40 + 1 AS STRING), '"}}')
  WHEN 1 THEN concat('{"decision": " ', gold_decision, ' ", "suggested_unit_number": ', CAST(gold_label_id % 3 AS STRING), ', "unit_number": null, "street_name": "Main St"}') WHEN 2 THEN '{"decision": "accept"' WHEN 3 THEN '["accept"]' WHEN 4 THEN '"accept"'
  WHEN 5 THEN concat('{"decision": "', gold_decision, '", "building_type": "multi_unit", "unit_number": "', CAST(gold_label_id % 40 + 1 AS STRING), '"}') ELSE concat('{"decision": null, "building_type": "single_unit", "unit_number": 0, "canonical": {"unit_number": "', CAST(gold_label_id % 40 + 1 AS STRING), '"}}') END"""


def _json_at(path: str) -> str:
    at = f"json_extract(j, '$.{path}')"
    return f"CASE WHEN json_type({at}) <> 'VARCHAR' AND json_extract_string(j, '$.{path}') IN ('0', '0.0', 'false') THEN NULL ELSE nullif(json_extract_string(j, '$.{path}'), '') END"


def _json_first(*paths: str) -> str:
    return f"coalesce({', '.join(_json_at(p) for p in paths)})"


_LABELS = f"""lj AS (SELECT *, {_JSON} AS label_json FROM gold0), lv AS (SELECT *, CASE WHEN json_valid(label_json) THEN CAST(label_json AS JSON) END AS j FROM lj),
lab AS (SELECT * EXCLUDE (j, gold_decision, gold_building_type, gold_unit_number), CASE WHEN lower(trim({_json_first('decision')})) = 'correct' THEN 'accept' ELSE trim({_json_first('decision')}) END AS gold_decision,
  trim({_json_first('building_type', 'structure_type')}) AS gold_building_type, {_unit(_json_first('unit_number', 'suggested_unit_number', 'canonical.unit_number'))} AS gold_unit_number, trim({_json_first('street_name', 'canonical.street_name')}) AS gold_street_name FROM lv)"""
_GOLD0 = ctes("gold").replace("gold AS", "gold0 AS", 1)


def _json_gold(spark, d):
    return label_json.with_labels(derived(spark, d, "gold").withColumn("label_json", F.expr(_JSON)))


@_query("label_values", f"WITH {_GOLD0}, {_LABELS} SELECT gold_label_id, gold_decision, gold_building_type, gold_unit_number, gold_street_name FROM lab")
def _label_values(spark, d):
    return _json_gold(spark, d).select("gold_label_id", "gold_decision", "gold_building_type", "gold_unit_number", "gold_street_name")


@_query("label_metrics", f"WITH {_GOLD0}, {_LABELS}, gold AS (SELECT * FROM lab), {ctes('raw', 'result')}, {_COMPARE}, k AS (SELECT field, count(g) AS total, count(*) - count(g) AS skipped, count(*) FILTER (g = p) AS tp, count(*) FILTER (g <> p) AS fp, count(*) FILTER (g IS NOT NULL AND g IS DISTINCT FROM p) AS fn FROM lng GROUP BY field), m AS (SELECT *, {_RATES} FROM k) SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 4) AS f1 FROM m")
def _label_metrics(spark, d):
    """The metrics of each field with labels read from JSON."""
    return evaluate.field_metrics(evaluate.gold_compare(_json_gold(spark, d), derived(spark, d, "raw"), derived(spark, d, "result")))


@_query("errors_in_metrics", f"""WITH {ctes('gold', 'raw', 'result')}, {_COMPARE}, e AS (SELECT source_id, confidence, row_number() OVER (ORDER BY gold_label_id, source_id) AS n FROM cmp WHERE g_decision IS NOT NULL AND g_decision IS DISTINCT FROM p_decision)
SELECT 'default' AS workspace_name, 'evaluation_error' AS source_name, source_id, 'decision' AS task_type, 100 AS priority, 'queued' AS status, 'Priority error bucket: decision' AS reason FROM e WHERE n <= 100 ORDER BY coalesce(confidence, 1), n LIMIT 25""")
def _errors(spark, d):
    """An evaluation's error samples, stored as metrics JSON with the newest model and read back from there."""
    samples = evaluate.error_samples(evaluate.gold_compare(*[derived(spark, d, n) for n in ("gold", "raw", "result")]))
    old = {"workspace_name": F.lit("default"), "status": F.lit("evaluated")}
    stored = labels.metrics_json(samples).withColumns({**old, "created_at": F.lit(2)})
    before = stored.withColumns({"metrics_json": F.lit('{"decision_errors": [{"source_id": "x"}]}'), "created_at": F.lit(1)})
    return labels.errors_in_metrics(before.unionByName(stored), "decision", "default", 25)


_REVIEWS = "SELECT queue_id, CASE queue_id % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'review' ELSE 'reject' END AS decision, CASE queue_id % 4 WHEN 0 THEN 'commercial' WHEN 1 THEN '' END AS building_type, CASE queue_id % 5 WHEN 0 THEN '12' WHEN 1 THEN '' END AS unit_number FROM queue WHERE queue_id % 2 = 0"


@_query("submit_reviews", f"""WITH {ctes('queue', 'result')}, rv AS ({_REVIEWS})
SELECT q.queue_id, q.source_id, CASE WHEN rv.decision = 'correct' THEN 'accept' ELSE rv.decision END AS decision, coalesce(nullif(rv.building_type, ''), r.building_type) AS building_type, coalesce(rv.unit_number, r.unit_number) AS unit_number,
  CASE WHEN r.raw_id IS NOT NULL THEN concat('was ', r.decision) END AS reason, rv.decision AS review_action FROM rv JOIN queue q ON rv.queue_id = q.queue_id LEFT JOIN result r ON CAST(r.raw_id AS VARCHAR) = q.source_id AND r.workspace_name = q.workspace_name""")
def _submit(spark, d):
    queue, results = derived(spark, d, "queue"), derived(spark, d, "result")
    reviews = spark.sql(_REVIEWS.replace("FROM queue", "FROM {queue}"), queue=queue).withColumn("notes", F.lit(None).cast("string"))
    made, _ = labels.submit_reviews(queue, reviews, results.withColumn("reason", F.concat(F.lit("was "), "decision")))
    value = lambda n: F.get_json_object("label_json", f"$.{n}").alias(n)
    return made.select("queue_id", "source_id", *[value(n) for n in ("decision", "building_type", "unit_number", "reason", "review_action")])


_SEEN = "SELECT workspace_name, reference_id AS raw_id, street_number, street_name, province, CASE reference_id % 4 WHEN 0 THEN NULL ELSE 'Nowhere' END AS city, CASE reference_id % 3 WHEN 0 THEN city WHEN 1 THEN 'Elsewhere' END AS municipality, CASE WHEN reference_id % 5 = 0 THEN upper(city) END AS county, reference_lat AS latitude, reference_lon AS longitude FROM reference WHERE is_active"
_FIT = _MATCH[_MATCH.index("CASE WHEN c1 IS NULL") + len("CASE WHEN ") : _MATCH.index(" THEN CAST(1 AS DOUBLE)")]
_ANY = _swapped(_MATCH, (_FIT, "(len(seen) = 0 OR len(list_filter(seen, lambda c1: " + _FIT + ")) > 0)"), (f"{_title('b.city')} AS c1", f"list_distinct(list_filter([{_title('b.city')}, {_title('b.municipality')}, {_title('b.county')}], lambda x: x IS NOT NULL)) AS seen"))


@_query("reference_localities", f"WITH {ctes('reference')}, b AS ({_SEEN}), {_ANY} SELECT b.raw_id, reference_id, reference_score FROM b LEFT JOIN mt ON b.raw_id = mt.raw_id")
def _localities(spark, d):
    """Rows that name a city, a municipality and a county, of which any may fit the reference."""
    references = derived(spark, d, "reference")
    rows = spark.sql(_SEEN.replace("FROM reference", "FROM {reference}"), reference=references)
    return match_reference(rows, references, observed=("city", "municipality", "county")).select("raw_id", "reference_id", "reference_score")
