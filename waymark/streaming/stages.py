"""Cleaning in four stages with a checkpoint for each row and stage.

Each stage takes the rows whose payload of the stage before is there and whose own is missing, and upserts its
payload; nulls keep what is stored. So a run that is cut off anywhere is taken up where it stopped, for each row by
itself, and a finished row costs a look at its bucket of the table. A row that a stage can't handle is stored with that stage and
the error, stays out of the later stages, and is tried again in the next run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.functions.profile import CountryProfile
from waymark.operators.candidates import DEFAULT_PARSERS, close_candidates, normalized, parsed
from waymark.operators.decision import DecisionPolicy, validate
from waymark.operators.keyed_table import KeyedTable
from waymark.operators.parsers import needs_refinement, refined
from waymark.operators.upsert import COALESCE, latest

STAGES = ("normalize", "parse", "validate", "publish")
PAYLOADS = {"normalize": "normalize_json", "parse": "parser_json", "validate": "validation_json"}
KEYS = ["workspace_name", "raw_id"]
_KEPT = (*PAYLOADS.values(), "reference_json", "decision", "confidence", "reason", "building_type", "suggested_unit_number", "base_address_key", "full_address_key")
SCHEMA = "workspace_name string, raw_id long, raw_address_text string, normalize_json string, parser_json string, validation_json string, reference_json string, decision string, confidence double, reason string, building_type string, suggested_unit_number string, base_address_key string, full_address_key string, checkpoint_stage string, checkpoint_status string, checkpoint_error string"
# What a refined row's reason begins with, and how its confidence is raised.
REFINED, BOOST, MOST = "LLM REFINED: ", 0.2, 0.95
_INSIGHTS = ("Heuristic segment matching confirmed Basement.", "Contextual analysis of text segments.")


def results_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    table = KeyedTable(spark, path, KEYS, buckets, rules={c: COALESCE for c in _KEPT})
    if table.manifest() is None:
        table.create(SCHEMA)
    return table


@dataclass(frozen=True)
class Cleaner:
    """How rows are cleaned. checks: for a stage, a column of the raw row that is an error text or null. refine: let the offline refiner see doubtful rows."""

    references: DataFrame
    policy: DecisionPolicy = field(default_factory=DecisionPolicy)
    profile: CountryProfile | str | None = None
    parsers: tuple[str, ...] = DEFAULT_PARSERS
    checks: dict[str, Column] = field(default_factory=dict)
    refine: bool = False

    def payload(self, stage: str, rows: DataFrame) -> DataFrame:
        """KEYS, raw_address_text and the columns that the stage fills."""
        own = [*KEYS, "raw_address_text"]
        if stage == "normalize":
            return normalized(rows, self.profile).select(*own, F.to_json(F.struct("normalized", "flags")).alias("normalize_json"))
        if stage == "parse":
            found = close_candidates(parsed(rows, self.profile, self.parsers, self.policy.parser_weights), self.policy.close_candidate_delta)
            ranked = F.array(*[F.col(c) for c in found.columns if c.startswith("cand_")])
            whole = F.struct(F.size(ranked).alias("parser_count"), F.col("best").alias("best_candidate"), ranked.alias("candidates"), "parser_disagreement", "alternate_units")
            return found.select(*own, F.to_json(whole).alias("parser_json"))
        return self._validated(rows, own)

    def _validated(self, rows: DataFrame, own: list[str]) -> DataFrame:
        out = validate(rows, self.references, self.policy, self.profile, self.parsers)
        reason, confidence, refinement = F.col("reason"), F.col("confidence"), F.lit(None).cast("string")
        if self.refine:
            p = F.col("best")["parsed"]
            basement = F.upper(F.coalesce("raw_address_text", F.lit(""))).contains("BSMT")
            asked = needs_refinement(p["parse_confidence"])
            refinement = F.when(asked, F.to_json(refined(F.coalesce("raw_address_text", F.lit("")), p)))
            reason = F.when(asked, F.concat(F.lit(REFINED), F.when(basement, _INSIGHTS[0]).otherwise(_INSIGHTS[1]))).otherwise(reason)
            confidence = F.when(asked, F.least(F.lit(MOST), F.coalesce(confidence, F.lit(0.0)) + BOOST)).otherwise(confidence)
        reference = F.when(F.col("reference_id").isNotNull(), F.to_json(F.struct("reference_id", F.col("reference_external_id").alias("external_id"), F.col("reference_score").alias("score"), F.col("reference_candidates").alias("candidates"), F.col("reference_units").alias("units"))))
        canonical = F.struct("street_number", "street_name", "unit_number", "city", "province", "postal_code", F.col("canonical_base_key").alias("base_address_key"), F.col("canonical_full_key").alias("full_address_key"))
        hints = F.struct("reference_score", "reference_candidates", "reference_units", "gps_conflict", "parser_disagreement", "alternate_units")
        whole = F.struct("decision", confidence.alias("confidence"), reason.alias("reason"), "building_type", F.col("suggested_unit").alias("suggested_unit_number"), canonical.alias("canonical"), hints.alias("hints"), refinement.alias("llm_refinement"))
        return out.select(
            *own, F.to_json(whole).alias("validation_json"), reference.alias("reference_json"), "decision", confidence.alias("confidence"), reason.alias("reason"), "building_type",
            F.col("suggested_unit").alias("suggested_unit_number"), F.col("canonical_base_key").alias("base_address_key"), F.col("canonical_full_key").alias("full_address_key"),
        )


def eligible(stage: str, rows: DataFrame, table: KeyedTable) -> DataFrame:
    """The raw rows that a stage has to do, one for each key."""
    state = table.rows_of(rows).select(*KEYS, *PAYLOADS.values(), "checkpoint_stage", "checkpoint_status")
    flags = state.select(*[F.col(k).alias(f"__{k}") for k in KEYS], *[F.col(c).isNotNull().alias(f"__{c}") for c in PAYLOADS.values()], ((F.col("checkpoint_stage") == "publish") & (F.col("checkpoint_status") == "completed")).alias("__done"))
    met = rows.join(flags, [rows[k].eqNullSafe(F.col(f"__{k}")) for k in KEYS], "left")
    has = lambda c: F.coalesce(F.col(f"__{c}"), F.lit(False))
    names = list(PAYLOADS.values())
    if stage == "publish":
        wanted = has(names[-1]) & ~F.coalesce("__done", F.lit(False))
    else:
        at = STAGES.index(stage)
        wanted = ~has(names[at])
        for before in names[:at]:
            wanted = wanted & has(before)
    return met.where(wanted).select(*rows.columns)


def run_stage(stage: str, rows: DataFrame, table: KeyedTable, cleaner: Cleaner) -> list[int]:
    """One stage over raw rows; the buckets of the table that it rewrote."""
    todo = eligible(stage, rows, table)
    error = cleaner.checks.get(stage, F.lit(None)).cast("string")
    todo = todo.withColumn("__error", error)
    at = {"checkpoint_stage": F.lit(stage), "checkpoint_error": F.lit(None).cast("string")}
    failed = todo.where("__error IS NOT NULL").select(*KEYS, "raw_address_text", F.lit("pending").alias("decision"), F.lit(stage).alias("checkpoint_stage"), F.lit("failed").alias("checkpoint_status"), F.col("__error").alias("checkpoint_error"))
    good = todo.where("__error IS NULL").drop("__error")
    if stage == "publish":
        done = good.select(*KEYS, "raw_address_text").withColumns(at | {"checkpoint_status": F.lit("completed")})
    else:
        done = cleaner.payload(stage, good).withColumns(at | {"checkpoint_status": F.lit("running")})
        if stage != "validate":
            done = done.withColumn("decision", F.lit("pending"))
    return table.upsert(done.unionByName(failed, allowMissingColumns=True))


def clean(raw: DataFrame, table: KeyedTable, cleaner: Cleaner) -> dict[str, list[int]]:
    """All stages over raw rows; the buckets that each rewrote."""
    rows = latest(raw, KEYS).select(raw.columns)
    return {stage: run_stage(stage, rows, table, cleaner) for stage in STAGES}


def progress(table: KeyedTable) -> DataFrame:
    """checkpoint_stage, checkpoint_status, n."""
    return table.read().groupBy("checkpoint_stage", "checkpoint_status").agg(F.count(F.lit(1)).alias("n"))


def clean_page(raw: DataFrame, table: KeyedTable, settings, cleaner: Cleaner, workspace: str = "default", size: int = 1000) -> dict:
    """The next active rows of a workspace by raw_id, cleaned; what is stored as cleaning.publish.last_raw_id goes on up to the first row that failed."""
    key = f"{workspace}.cleaning.publish.last_raw_id"
    stored = None if (df := settings.read()) is None else df.where(F.col("setting_key") == key).select("setting_value").first()
    last = int(stored[0]) if stored else 0
    rows = raw.where("is_active").where((F.col("workspace_name") == workspace) & (F.col("raw_id") > last)).orderBy("raw_id").limit(size)
    clean(rows, table, cleaner)
    state = table.rows_of(rows).join(rows.select(*KEYS), KEYS)
    done = (F.col("checkpoint_stage") == "publish") & (F.col("checkpoint_status") == "completed")
    seen = state.agg(F.count(F.lit(1)).alias("seen"), F.count_if(done).alias("processed"), F.min(F.when(~done, F.col("raw_id"))).alias("failed"), F.max("raw_id").alias("last")).first()
    reached = state.where(done & (F.col("raw_id") < F.lit(seen["failed"]) if seen["failed"] is not None else done)).agg(F.max("raw_id")).first()[0]
    if reached is not None:
        settings.upsert(raw.sparkSession.createDataFrame([(key, str(reached))], "setting_key string, setting_value string"), ["setting_key"])
    return {"records_seen": seen["seen"], "records_processed": seen["processed"], "next_raw_id": last if reached is None else reached, "has_more": seen["seen"] >= size, "failed_raw_id": seen["failed"]}


def staged_stream(raw: DataFrame, table: KeyedTable, cleaner: Cleaner, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Cleans a stream of raw rows stage by stage; a batch that is run again finds its stages done."""
    writer = raw.writeStream.foreachBatch(lambda batch, _: clean(batch, table, cleaner) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
