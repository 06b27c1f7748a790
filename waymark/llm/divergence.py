"""Audit of how the sources of a language differ in their terms: heavy terms in dense tiles, light ones as postings.

The divergence of two groups (language, source) sums f(p, q) over all kept terms of the language, where a
group without a term still has a share p0 of it. With f0 = f(p0 of one, p0 of the other) the sum over V terms is

    V f0  +  sum over heavy terms (f - f0)  +  sum over light terms (f - f0).

Heavy terms (in more than a quarter of the language's groups) lie in tiles of some TILE terms and blocks of
BLOCK groups: a task fills a numpy matrix for each of two blocks and sums f over its terms. Light terms go by their
postings. For a light term of which only one group has some, f depends on that group's count and on the other's
p0 alone, so a histogram of counts for each group does for all of them at once; for each pair of groups in one
posting a correction brings that to f(p, q). All parts are whole numbers of 64 bits (f is at most |p - q|, so a sum
over V terms stays below 2e9 + 2V) and shares are divided as 38-digit decimals, so the sum is exact.

Texts are cut and counted in tasks, which pass on counts by (language, source, term), so a hot source is as many
rows as the tasks that saw it times its terms.

Defined cases: null text, language and source are the empty string; groups without a term, languages without a
kept term (all values 0) and languages with one source (no pairs) are reported as the contract says; repeated
rows count each; texts of any length are read whole; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import table, written

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms in a tile, about, and groups in a block; parts of the light terms' histograms.
TILE = 512
BLOCK = 256
PARTS = 8
#: Distinct terms that a task counts before it passes them on.
MOST_HELD = 200_000
#: ASCII letters in lower case, other ASCII characters as blanks; bytes of other characters stay.
_TERM_BYTES = bytes(b if b >= 128 else (b | 32 if chr(b).isalpha() else 32) for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (times) and d (documents) for each term of each group."""

    def run(batches):
        times: dict[tuple, Counter] = defaultdict(Counter)
        within: dict[tuple, Counter] = defaultdict(Counter)
        held = 0

        def passed_on():
            for (lang, source), counts in times.items():
                seen = within[lang, source]
                terms = list(counts)
                cols = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array(counts.values(), pa.int64(), size=len(terms)), pa.array([seen[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "d"])

        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in ("lang", "source", "text"))):
                terms = terms_of(text)
                if not terms:
                    continue
                counts = times[lang, source]
                held -= len(counts)
                counts.update(terms)
                held += len(counts)
                within[lang, source].update(set(terms))
                if held > MOST_HELD:
                    yield from passed_on()
                    times.clear()
                    within.clear()
                    held = 0
        yield from passed_on()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact; 1 where v is 0."""
    whole = F.lit(SCALE).cast("decimal(38,0)") * (n + 2).cast("decimal(20,0)")
    return F.when(v == 0, F.lit(1).cast("long")).otherwise(1 + F.call_function("div", whole, (total + 2 * v).cast("decimal(20,0)")))


def term_distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return ((d * d).view(np.uint64) // (p + q).view(np.uint64)).view(np.int64)


class Audit:
    """Terms, groups and divergences of docs (lang, source, text). light: share of a language's groups up to which a term is light."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, light: float = 0.25, tile: int = TILE, block: int = BLOCK):
        self.tile, self.block = tile, block
        docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
        counts = written(term_counts(docs), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("docs"), F.count(F.lit(1)).alias("k")).where(F.col("docs") >= min_docs)
        kept = written(kept.drop("docs"), "kept-terms")
        n_of = counts.join(kept, ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
        groups = docs.select("lang", "source").distinct().join(n_of, ["lang", "source"], "left").fillna(0, "n_group")
        langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("g"))
        limit = F.greatest(F.lit(4), F.floor(F.col("g") * light))
        by_k = kept.groupBy("lang", "k").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("terms"))  # no more rows than groups meet the languages
        of_lang = by_k.join(langs, "lang").groupBy("lang").agg(F.sum("total").alias("n_lang"), F.sum("terms").alias("v"), F.sum(F.when(F.col("k") > limit, F.col("terms")).otherwise(0)).alias("heavy"))
        langs = langs.join(of_lang, "lang", "left").fillna(0, ["n_lang", "v", "heavy"]).withColumn("light_limit", limit)
        self.langs = written(langs, "languages")
        # one row for each group, fewer by far than the pairs to report, so a language's groups may be numbered in one task
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
        groups = groups.withColumn("gid", number).join(self.langs, "lang")
        groups = groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("n_group"), F.col("v")))
        self.groups = written(groups, "groups")
        about = self.groups.select("lang", "source", "gid", "n_group", "v", "p0", "heavy", "light_limit", "n_lang", "g")
        cells = counts.drop("d").join(kept, ["lang", "term"]).join(about, ["lang", "source"])
        q = share(F.col("total"), F.col("n_lang"), F.col("v"))
        cells = cells.withColumn("p", share(F.col("n"), F.col("n_group"), F.col("v"))).withColumn("q", q)
        self.cells = written(cells.select("lang", "source", "gid", "term", "n", "p", "q", "p0", "heavy", "g", (F.col("k") <= F.col("light_limit")).alias("is_light")), "cells")

    def top_terms(self, top: int = TOP_TERMS) -> DataFrame:
        """lang, source, item, value, rank: the terms that a group has more of than its language, the farthest first."""
        over = self.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), term_distance(F.col("p"), F.col("q")).alias("value"))
        return over.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= top)

    def _tiles(self) -> DataFrame:
        """lang, g, h, value of the terms in tiles (tile 0 and up), of the one-sided light ones in PARTS (tiles below 0) and of all terms' base (with tile -1), g < h."""
        tiles = F.ceil(F.col("heavy") / self.tile).cast("long")
        row = ["lang", "g", "tile", "gid", "kind", "term", "p", "w"]
        heavy = self.cells.where("NOT is_light").withColumn("tile", F.pmod(F.xxhash64("term"), tiles)).withColumn("kind", F.lit(1)).withColumn("w", F.lit(1).cast("long"))
        hist = self.cells.where("is_light").groupBy("lang", "g", "gid", "p").agg(F.count(F.lit(1)).alias("w")).withColumn("tile", -1 - F.pmod(F.xxhash64("p"), F.lit(PARTS).cast("long"))).withColumn("kind", F.lit(2)).withColumn("term", F.lit(None).cast("string"))
        base = self.groups.withColumn("tile", F.explode(F.sequence(F.lit(-PARTS).cast("long"), tiles - 1))).select("lang", "g", "tile", "gid", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.when(F.col("tile") == -1, F.col("v")).otherwise(0).alias("w"))
        rows = heavy.select(row).union(hist.select(row)).union(base)
        # each block meets each other one: a row goes to as many tasks as the language has blocks
        blocks = F.ceil(F.col("g") / self.block).cast("long")
        rows = rows.withColumn("own", F.floor(F.col("gid") / self.block)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        rows = rows.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("own", "other", "g")
        block = self.block

        def run(key, t):
            lang, tile, bi, bj = (k.as_py() for k in key)
            gid, kind, p, w = (t.column(c).to_numpy() for c in ("gid", "kind", "p", "w"))
            ids = np.unique(gid)  # every group of both blocks has a base row
            at = np.searchsorted(ids, gid)
            p0, v = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
            p0[at[kind == 0]], v[at[kind == 0]] = p[kind == 0], w[kind == 0]
            first, last = (np.flatnonzero(ids // block == k) for k in (bi, bj))
            out = []
            if tile >= 0:
                cell = kind == 1
                terms = t.column("term").filter(pa.array(cell)).combine_chunks().dictionary_encode()
                n_terms = len(terms.dictionary)
                dense = np.repeat(p0[:, None], n_terms, axis=1)
                dense[at[cell], terms.indices.to_numpy()] = p[cell]
                for i in first:
                    js = last[last > i]
                    if len(js):
                        out.append((i, js, _f(dense[js], dense[i][None, :]).sum(axis=1) - n_terms * _f(p0[js], p0[i])))
            else:
                ordered = np.lexsort((p, at))[: len(at)]
                ordered = ordered[kind[ordered] == 2]
                starts, ends = (np.searchsorted(at[ordered], np.arange(len(ids)), side) for side in ("left", "right"))
                side = np.zeros((len(ids), len(ids)), np.int64)  # of the terms that only the row's group has, against the column's p0
                for i in np.concatenate([first, last]) if bi != bj else first:
                    mine = ordered[starts[i] : ends[i]]
                    if len(mine):
                        side[i] = (w[mine][:, None] * (_f(p[mine][:, None], p0[None, :]) - _f(np.full_like(p0, p0[i]), p0)[None, :])).sum(axis=0)
                for i in first:
                    js = last[last > i]
                    if len(js):
                        out.append((i, js, v[i] * _f(p0[js], p0[i]) + side[i, js] + side[js, i]))
            g = np.concatenate([np.full(len(js), ids[i]) for i, js, _ in out]) if out else np.empty(0, np.int64)
            h = np.concatenate([ids[js] for _, js, _ in out]) if out else g
            value = np.concatenate([x for _, _, x in out]) if out else g
            return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(g, pa.int64()), "h": pa.array(h, pa.int64()), "value": pa.array(value, pa.int64())})

        return rows.groupBy("lang", "tile", "bi", "bj").applyInArrow(run, "lang string, g long, h long, value long")

    def _corrections(self) -> DataFrame:
        """lang, g, h, value for each pair g < h in a light term's posting; a posting has at most a quarter of the language's groups (light)."""
        postings = self.cells.where("is_light").groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("gid", "p", "p0"))).alias("posting")).where(F.size("posting") > 1)
        one = postings.select("lang", "posting", F.posexplode("posting").alias("at", "a"))
        two = one.select("lang", "a", F.explode(F.slice("posting", F.col("at") + 2, F.size("posting"))).alias("b"))
        f = lambda x, y: term_distance(F.col(x), F.col(y))
        value = f("a.p", "b.p") - f("a.p", "b.p0") - f("a.p0", "b.p") + f("a.p0", "b.p0")
        return two.select("lang", F.col("a.gid").alias("g"), F.col("b.gid").alias("h"), value.alias("value")).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value, rank."""
        both = written(self._tiles().union(self._corrections()).groupBy("lang", "g", "h").agg(F.sum("value").alias("value")), "pairs")
        each = both.union(both.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
        name = lambda gid, as_: self.groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(as_))
        named = each.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"])
        return named.select("lang", "source", "item", "value", F.row_number().over(_order()).alias("rank"))


def _order():
    return Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    audit = Audit(table(spark, sf_dir, "documents"))
    row = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return audit.pairs().withColumn("part", F.lit("pair")).select(row).union(audit.top_terms().withColumn("part", F.lit("term")).select(row))


#: DuckDB SQL with the same rows.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM t GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
l AS (SELECT lang, CAST(sum(total) AS BIGINT) AS nl, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, CAST(coalesce(sum(n) FILTER (kept.term IS NOT NULL), 0) AS BIGINT) AS ng FROM g
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN kept ON kept.lang = c.lang AND kept.term = c.term GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // (ng + 2 * v) AS BIGINT) AS p,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (nl + 2 * v) AS BIGINT) AS q
  FROM gn JOIN l ON l.lang = gn.lang JOIN kept ON kept.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10
"""
