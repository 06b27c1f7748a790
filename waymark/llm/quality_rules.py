"""Host-level quality rules with DataFrame functions only.

Every text gets its measures in one pass without a shuffle. Rules turn them into failures; failures
are counted for each host (here: source), each host's failure rate is shrunk toward an empirical beta
prior fitted by moments over all hosts, and the host's verdict joins its documents. A document stays
if it passes the base rules, its own symbol rule, and its host's verdict.

Repeated windows are found inside the row: words become 64-bit hashes, windows of eight hashes
become one hash each; only where those aren't all distinct are they sorted with their positions, so
the work for a text is its length times the logarithm.

Defined cases: null text counts as a text without words (base rules fail); null hosts form one host;
a single host gets a flat prior; no rows give no rows; repeated rows count each time. Extra columns
whose names clash with the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BLANKS, let, table, words, written

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Symbols for each 100 words above which a text is called broken markup.
MAX_SYMBOLS_PERCENT = 50
#: Shrunk failure rate above which a host's documents all go.
MAX_HOST_RATE = 0.5


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of that many words (a power of two) found twice or more in the text."""

    def windows(hashes: Column) -> Column:
        # A window of 8 is the pair of two windows of 4, and so on: three passes instead of eight look-ups a word.
        def paired(h: Column, step: int) -> Column:
            joined = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + F.lit(step))))
            return let(joined, lambda j: paired(j, 2 * step)) if 2 * step < window else joined

        return F.slice(paired(hashes, 1), F.lit(1), F.size(hashes) - F.lit(window - 1))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        first = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(let(ordered, starts), first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])

    def count(hashes: Column) -> Column:
        return let(windows(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return F.when(F.size(tokens) <= window, F.lit(0).cast("long")).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), count))


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_words = let(words(F.col("text")), lambda t: F.struct(F.size(t).cast("long"), F.length(F.array_join(t, "")).cast("long"), repeated_words(t)))
    of_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    n_symbols = (F.size(F.split(text, SYMBOLS)) - 1).cast("long")
    found = F.struct(of_words.alias("w"), n_symbols.alias("s"), of_lines.alias("d"))
    docs = docs.withColumn("__m", F.explode(F.array(found)))  # a generator keeps the optimizer from computing the words for each use
    w = F.col("__m.w")
    names = {"n_words": w["col1"], "word_chars": w["col2"], "n_symbols": F.col("__m.s"), "n_dup_lines": F.col("__m.d"), "n_repeat_words": w["col3"]}
    return docs.withColumns(names).drop("__m")


def host_rates(failures: DataFrame, host: str = "host") -> DataFrame:
    """host, n, n_failed, rate (shrunk) from rows (host, failed boolean).

    The beta prior has the mean of all rows and the strength that the variance between hosts tells by
    moments: mean(1-mean)/variance - 1, no less than 1; without variance it's the number of rows.
    """
    by_host = written(failures.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed")), "host-failures")
    r = F.col("n_failed") / F.col("n")
    p = by_host.agg(F.sum("n_failed").alias("failed"), F.sum("n").alias("n"), F.avg(r).alias("mean"), F.var_pop(r).alias("var")).first()
    if not p["n"]:
        return by_host.withColumn("rate", F.lit(0.0))
    strength = max(1.0, p["mean"] * (1 - p["mean"]) / p["var"] - 1) if p["var"] > 1e-12 else float(p["n"])
    mean = p["failed"] / p["n"]
    return by_host.withColumn("rate", (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed", "host_rate", "kept")


def ruled(docs: DataFrame) -> DataFrame:
    """docs with measures, base_failed and rule_failed."""
    docs = measures(docs.drop(*[c for c in OWN if c in docs.columns]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = 100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("n_words")
    return docs.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | broken)


def with_verdicts(rows: DataFrame, failures: DataFrame, host: str = "source") -> DataFrame:
    """rows (of ruled) with host_rate and kept; failures: host, failed of all rows."""
    rates = written(host_rates(failures).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate")), "host-rates")
    out = rows.join(rates, rows[host].eqNullSafe(rates["__host"]), "left").drop("__host")
    return out.withColumn("kept", ~F.col("rule_failed") & (F.col("host_rate") <= MAX_HOST_RATE))


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """Each row's columns but its text, with measures, base_failed, rule_failed, host_rate and kept.

    The measures are written once without texts, so that texts are read once and never shuffled.
    """
    slim = written(ruled(docs).drop("text"), "measures")
    return with_verdicts(slim, slim.select(F.col(host).alias("host"), F.col("rule_failed").alias("failed")), host)


def kept_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that are kept, unchanged.

    Texts are measured twice, for the hosts' rates and for the rows' own verdicts, rather than joined
    with a table of verdicts: what the rows meet has a row for each host, so no text is shuffled.
    """
    failures = ruled(docs.select("text", F.col(host).alias("host"))).select("host", F.col("rule_failed").alias("failed"))
    rows = docs.select(F.struct("*").alias("__row"), F.col(host).alias("__source"), "text")
    return with_verdicts(ruled(rows), failures, "__source").where("kept").select("__row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judged(docs).select("doc_id", *OWN[:6], F.round("host_rate", 6).alias("host_rate"), "kept")


#: DuckDB SQL with the same rows.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(i - p, 8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
j AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
        (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 50 * n_words) AS rule_failed FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (rule_failed) AS DOUBLE) AS f FROM j GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS mean, CASE WHEN var_pop(f / n) > 1e-12 THEN greatest(1.0, avg(f / n) * (1 - avg(f / n)) / var_pop(f / n) - 1) ELSE sum(n) END AS s FROM h),
r AS (SELECT source, (f + mean * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
  (NOT rule_failed AND rate <= 0.5) AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""
