"""Language ID with bit-sliced Bloom filters of character n-grams.

One filter holds all languages: a slot has a bitmask with one bit for each language (slices of 64
languages side by side), so two look-ups return every language that contains an n-gram. A text's
n-grams give a popcount for each language; the filter's false-positive rate is taken out of it, and
the language with the largest corrected share is predicted.

Learning counts all labelled rows: each partition counts its distinct (language, n-gram) pairs,
Spark adds them up, and an n-gram belongs to a language if it is at least SHARE times as frequent
there as where it is most frequent. An n-gram seen less than MIN_COUNT times in a language isn't one of
that language's; of more than MAX_GRAMS a language keeps its most frequent ones (whole classes of like
frequency), which bounds the model by a parameter, however large the corpus is. The filter has 8 slots for
each n-gram of the language with the most (SLOTS at least), so no language's false-positive rate
exceeds 0.05, and at most 8 * MAX_GRAMS slots of 8 bytes (64 MB) for each 64 languages are sent to the executors.

Defined cases: null text or text without a letter gives ``und`` with score 0; texts shorter than the
n-gram are padded with blanks; without any training row every prediction is ``und``; ties go to the
language that sorts first; repeated rows are predicted alike; texts of any length are read whole; of
other columns, lang_pred and score are replaced by predict() (rename them before to keep them).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import id_crc, table, written

N = 4
SLOTS = 1 << 20
HASHES = 2
SHARE = 0.2
MIN_COUNT = 2
MAX_GRAMS = 1 << 20
#: Classes of frequency for each doubling.
_CLASSES = 8
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")
# Odd multipliers of the slot hashes.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def grams(text: str | None, n: int = N) -> np.ndarray:
    """Keys of the n-grams of letters and single blanks; empty if there is no letter."""
    letters = _OTHER.sub(" ", (text or "").lower()).strip()
    if not letters:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(f" {letters} ".ljust(n).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out = (out << np.uint64(16)) ^ codes[k : len(codes) - n + 1 + k]
    return out


def slots_of(keys: np.ndarray, k: int, slots: int) -> np.ndarray:
    h = keys * _MULTIPLIERS[k]
    h ^= h >> np.uint64(29)
    return ((h * _MULTIPLIERS[2]) >> np.uint64(34)) & np.uint64(slots - 1)


def slots_for(grams: int, least: int = SLOTS) -> int:
    """Slots of a filter for so many n-grams of one language: a power of two, 8 for each and least at least; its false-positive rate is below 0.05."""
    return max(least, 1 << max(0, 8 * grams - 1).bit_length())


def _counts(batches, n: int):
    """Each partition's counts of (language, n-gram)."""
    pending: dict[str, list] = {}
    held = 0

    def flush():
        for lang, parts in pending.items():
            keys, counts = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.bincount(counts, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
            pending[lang] = [(keys, total)]

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            keys = grams(text, n)
            pending.setdefault(lang, []).append((keys, np.ones(len(keys))))
            held += len(keys)
            if held > 2_000_000:
                flush()
                held = 0
    flush()
    for lang, parts in pending.items():
        for keys, total in parts:
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(total[i : i + 100_000])], names=["lang", "gram", "n"])


@dataclass
class LanguageModel:
    """langs: sorted; masks: (slices, slots) bitmasks; fills: each language's false-positive rate."""

    langs: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    n: int
    hashes: int

    def score(self, text: str | None) -> tuple[str, float]:
        keys = grams(text, self.n)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        at = [slots_of(keys, k, self.masks.shape[1]).astype(np.int64) for k in range(self.hashes)]
        hits = []
        for s in range(self.masks.shape[0]):
            found = self.masks[s][at[0]]
            for a in at[1:]:
                found &= self.masks[s][a]
            for b in range(min(64, len(self.langs) - 64 * s)):
                hits.append(np.count_nonzero(found & np.uint64(1 << b)))
        rate = np.array(hits) / len(keys)
        corrected = np.clip((rate - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = int(np.argmax(corrected))
        return self.langs[best], float(corrected[best])


def fit(labelled: DataFrame, n: int = N, slots: int | None = None, hashes: int = HASHES, share: float = SHARE, min_count: int = MIN_COUNT, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """A model of all rows of labelled (text, lang) with a language. slots: a power of two, by default as slots_for() has it."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(lambda b: _counts(b, n), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))  # as many entries as there are languages
    counts = written(counts, "lang-grams")
    totals = {r["lang"]: r["n"] for r in counts.select(F.inline("by")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    slices = max(1, -(-len(langs) // 64))
    at = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.struct(F.lit(i).alias("i"), F.lit(float(totals[lang])).alias("t")))]) if langs else None
    if langs:
        rates = F.transform("by", lambda x: F.struct(F.element_at(at, x["lang"])["i"].alias("i"), x["n"].alias("n"), (x["n"] / F.element_at(at, x["lang"])["t"]).alias("rate")))
        kept = counts.select("gram", rates.alias("r")).select("gram", F.expr(f"transform(filter(r, x -> x.n >= {int(min_count)} AND x.rate >= {float(share)} * array_max(transform(r, y -> y.rate))), x -> struct(x.i AS i, x.n AS n))").alias("langs"))
        kept = kept.select("gram", F.inline("langs")).withColumn("class", F.floor(F.log2("n") * _CLASSES).cast("int"))
        sizes = kept.groupBy("i", "class").agg(F.count(F.lit(1)).alias("n")).orderBy("i", F.col("class").desc()).collect()  # some hundred classes a language at most
        least, held = {}, Counter()
        for r in sizes:
            if held[r["i"]] + r["n"] <= max_grams or not held[r["i"]]:
                held[r["i"]] += r["n"]
                least[r["i"]] = r["class"]
            else:
                held[r["i"]] = max(held[r["i"]], max_grams)  # full: no class below gets in
        if slots is None:
            slots = slots_for(max(held.values(), default=0))
        floors = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else None
        kept = kept.where(F.col("class") >= F.element_at(floors, F.col("i"))) if least else kept
        kept = kept.groupBy("gram", F.expr("i div 64").alias("slice")).agg(F.expr("bit_or(shiftleft(1L, CAST(i % 64 AS INT)))").alias("mask"))

        def place(batches):
            for b in batches:
                keys = b.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
                for k in range(hashes):
                    yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(slots_of(keys, k, slots).astype(np.int64)), b.column("mask")], names=["slice", "slot", "mask"])

        masks = np.zeros((slices, slots), np.uint64)
        filled = kept.select(F.col("gram"), F.col("slice").cast("long"), "mask").mapInArrow(place, "slice long, slot long, mask long").groupBy("slice", "slot").agg(F.bit_or("mask").alias("mask"))
        for part in filled.toArrow().to_batches():  # at most slices * slots rows
            masks[part.column("slice").to_numpy(), part.column("slot").to_numpy()] = part.column("mask").to_numpy().view(np.uint64)
    else:
        masks = np.zeros((slices, slots or SLOTS), np.uint64)
    slots = masks.shape[1]
    fill = np.array([np.count_nonzero(masks[i // 64] & np.uint64(1 << (i % 64))) / slots for i in range(len(langs))])
    return LanguageModel(langs, masks, fill**hashes, n, hashes)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    clash = [c for c in ("lang_pred", "score") if c in docs.columns]
    docs = docs.drop(*clash)

    def run(batches):
        own = shared.value
        for b in batches:
            found = [own.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    model = fit(docs.where(~held_out))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
