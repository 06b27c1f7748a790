"""Corpus preparation: language ID, quality rules, near-duplicate removal, source mixing, BPE ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Language ID learns
from the labelled rows of its own input and rejects texts without a letter or with less than
MIN_SCORE of their n-grams known in the best language. Near duplicates are texts whose five-word
shingles are similar by 0.8 or more, found by SimHash fingerprints and a pivot distance table (similar.py). Mixing repeats rows as often as the mix takes
them. The last stage returns the digest columns of the encoder. Stages that hand texts to Python bound the
session's Arrow batches by bytes (common.bounded_batches).

Defined cases, besides those of the operators: null and letterless texts are rejected by the first stage, texts
without words by the second at the latest; rows with a null id stay in near-duplicate removal, and ties there go
to the least id, then the least hash of the text; repeated rows are one document; no rows give no rows; further
columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.llm import bpe, language_id, mixing, quality_rules, similar
from waymark.llm.common import bounded_batches, written

MIN_SCORE = 0.3


def stage_language(spark, docs, sf_dir):
    """docs' columns as they are, whatever their names: the model sees them renamed."""
    bounded_batches(spark)
    names = {c: c if c in ("text", "lang") else f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    found = language_id.predict(rows.withColumnRenamed("lang", "__lang"), language_id.fit(rows.select("text", "lang")))
    found = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return found.withColumnRenamed("__lang", "lang").select([F.col(new).alias(old) for old, new in names.items()])


def stage_quality(spark, docs, sf_dir):
    return quality_rules.kept_documents(docs)


def stage_near_duplicates(spark, docs, sf_dir):
    bounded_batches(spark)
    return similar.deduplicated(docs)


def stage_mixing(spark, docs, sf_dir):
    return mixing.repeated(docs)


def stage_bpe(spark, docs, sf_dir):
    bounded_batches(spark)
    return bpe.encoded(docs)


STAGES = [
    ("language_id", stage_language),
    ("quality_rules", stage_quality),
    ("simhash_dedup", stage_near_duplicates),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: No SQL: language ID, SimHash and BPE can't be expressed; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
