import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from waymark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "lang string, source string, text string, term string, n string"


def brute(rows, min_docs):
    """Rows (lang, source, part, item, value, rank) of documents (lang, source, text)."""
    counts, docs, out = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in docs.keys() | {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        groups = {g[1]: c for g, c in counts.items() if g[0] == lang}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(sorted(terms)[:10], 1)}
    return out


def audit(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash", None) for r in rows], KIND).repartition(3)
    a = divergence.Audit(docs, **options)
    found = a.pairs().withColumn("part", F.lit("pair")).unionByName(a.top_terms().withColumn("part", F.lit("term")))
    found = [tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(found)) == len(found)
    return set(found)


def some(seed, n_groups, n_docs):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdé字" for b in "xyz"] + ["Été", "ÉTÉ", "İ", "K", "don't", "a-b", "x1y"]
    return [(rng.choice(["en", "fr", None]), rng.choice([f"s{k}" for k in range(n_groups)] + [None]), " ".join(rng.choices(words[: rng.randrange(1, len(words) + 1)], k=rng.randrange(0, 30)))) for _ in range(n_docs)]


@pytest.mark.parametrize("options", [{}, {"light": 1.0}, {"light": 0.0, "tile": 3, "block": 2}, {"light": 0.5, "tile": 2, "block": 5}])
def test_matches_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_HELD", 7)
    rows = some(len(options), 12, 300)
    assert audit(spark, rows, min_docs=4, **options) == brute(rows, 4)


def test_odd_documents(spark):
    rows = [("en", "a", None), ("en", "b", ""), ("en", None, "1 2 !?"), ("xx", "only", "one two"), (None, None, None), ("de", "a", "w"), ("de", "b", "v v v")]
    assert audit(spark, rows) == brute(rows, 10)  # no term is kept: all values 0
    rows += [("en", "a", "the same text again")] * 12 + [("en", "long", "the " * 50_000 + "Zebra")] + [("en", "b", "THE\x00same\x7ftext")] * 3
    assert audit(spark, rows) == brute(rows, 10)
    assert audit(spark, []) == set()


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 123_456_789_012, 9_876_543_210_987, 1_234_567
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)
