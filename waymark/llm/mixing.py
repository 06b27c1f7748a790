"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. Their sizes are added up by membership pattern (the set of
sources), and a flow routes the patterns' tokens to the sources' quotas: pattern -> source arcs carry
a pattern's tokens, each pass over the same tokens costs more than the one before (convex cost), and
a source takes its quota at most. The network has a node for each pattern and source, not for
documents; it is solved by cheapest augmenting paths, a maximum flow for each pass. Then every pattern's flow to a source is turned
into documents: full passes for all, and for the rest documents in the seeded order of md5(seed, id)
until the running sum passes the remainder's middle. Running sums are taken in two steps (hash range,
then rows of the one range in which the remainder ends), so no source is ordered in one task.

Targets: weights 1, 2, 3, repeating over sources in code-point order (null last); targets stop at
MAX_PASSES times the source's size and the excess is shared again by weight, which ends at the
level L with sum(min(cap, L * weight)) = total.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own, last; no
document exceeds MAX_PASSES times its size; no rows give no rows; rows with equal ids share their
place in the order and are told apart by size, then taken alike; more than MAX_PATTERNS membership
patterns raise an error; the stage (repeated) keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import small, table, word_count, written

MAX_PASSES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Documents for each range of the seeded hash: ranges are named by as many hex digits as that takes, three at least.
RANGE_DOCS = 100_000
#: Membership patterns at most: their sums and the flow are worked out on the driver, a few rows for each.
MAX_PATTERNS = 100_000


def targets(sizes: list[int], weights: list[int], max_passes: int = MAX_PASSES) -> list[float]:
    """Each source's target: shares of sum(sizes) by weight, at most max_passes * size."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] * max_passes / weights[i], i))
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        if max_passes * sizes[i] * weight > left * weights[i]:
            for j in order[k:]:
                out[j] = left / weight * weights[j]
            break
        out[i] = float(max_passes * sizes[i])
        left, weight = left - max_passes * sizes[i], weight - weights[i]
    return out


def flow(capacity: dict[tuple, int], quota: dict, max_passes: int = MAX_PASSES) -> dict[tuple, dict]:
    """Integer tokens from each pattern (tuple of sources) to each of its sources: of the largest flows one with the least cost.

    Pattern p has capacity[p] tokens for each pass, pass k costs k, and a source takes its quota at most. Costs lie
    on a pattern's passes only and an augmenting path never leaves a pattern's supply again, so its cost is that of
    the pass it starts with. Cheapest paths first is therefore one maximum flow a pass, each built upon the one
    before; a flow is raised in rounds over shortest paths, of which there are at most as many as sources.
    """
    patterns, sources = list(capacity), list(quota)
    number = {s: j for j, s in enumerate(sources)}
    of = [[number[s] for s in p] for p in patterns]
    sent = [dict.fromkeys(own, 0) for own in of]
    holders: list[list[int]] = [[] for _ in sources]
    for i, own in enumerate(of):
        for j in own:
            holders[j].append(i)
    room, supply = [int(quota[s]) for s in sources], [0] * len(patterns)
    for _ in range(max_passes):
        for i, p in enumerate(patterns):
            supply[i] += capacity[p]
        while _raise(of, holders, sent, supply, room):
            pass
    return {p: {sources[j]: n for j, n in by.items() if n} for p, by in zip(patterns, sent)}


def _raise(of: list[list[int]], holders: list[list[int]], sent: list[dict], supply: list[int], room: list[int]) -> bool:
    """One round: tokens move along shortest paths from patterns with supply to sources with room; False if there is no path.

    A path alternates patterns and sources; from a full source it goes on by a pattern that gives to it and can give elsewhere.
    """
    pattern_level: list = [None] * len(of)
    source_level = [0 if r > 0 else None for r in room]
    frontier, level = [j for j, r in enumerate(room) if r > 0], 0
    while frontier:
        reached = []
        for j in frontier:
            for i in holders[j]:
                if pattern_level[i] is None:
                    pattern_level[i] = level + 1
                    reached.append(i)
        frontier, level = [], level + 2
        for i in reached:
            for j in of[i]:
                if source_level[j] is None and sent[i][j] > 0:
                    source_level[j] = level
                    frontier.append(j)
    from_pattern, from_source, moved = [0] * len(of), [0] * len(room), False
    for start in range(len(of)):
        if pattern_level[start] is None:
            continue
        path = [start]
        while path and supply[start] > 0:
            at = path[-1]
            if len(path) % 2:  # at a pattern
                k = from_pattern[at]
                if k == len(of[at]):
                    path.pop()
                    if path:
                        from_source[path[-1]] += 1
                elif source_level[of[at][k]] == pattern_level[at] - 1:
                    path.append(of[at][k])
                else:
                    from_pattern[at] += 1
            elif source_level[at] == 0 and room[at] > 0:
                n = min(supply[start], room[at], *(sent[path[x]][path[x - 1]] for x in range(2, len(path), 2)))
                for x in range(0, len(path), 2):
                    sent[path[x]][path[x + 1]] += n
                    if x:
                        sent[path[x]][path[x - 1]] -= n
                supply[start] -= n
                room[at] -= n
                moved = True
                path = path[:1]
            else:
                k = from_source[at]
                if source_level[at] == 0 or k == len(holders[at]):
                    path.pop()
                    from_pattern[path[-1]] += 1
                elif pattern_level[holders[at][k]] == source_level[at] - 1 and sent[holders[at][k]].get(at, 0) > 0:
                    path.append(holders[at][k])
                else:
                    from_source[at] += 1
    return moved


def _keyed(docs: DataFrame, id_col: str, sources: str, seed: str) -> DataFrame:
    """docs with __pattern, __order (seeded) and __range (of the order)."""
    names = F.sort_array(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.withColumn("__pattern", F.to_json(F.struct(names.alias("s")), {"ignoreNullFields": "false"})).withColumn("__order", order)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", sources: str = "sources", size: str = "size", max_passes: int = MAX_PASSES, seed: str = SEED) -> tuple[DataFrame, dict]:
    """A row for each membership pattern: full passes, and the key (range, order, id, size) up to which documents are taken once more; and the plan in numbers.

    sources: array of the names a document belongs to (nulls are a name). Patterns and sources are
    aggregated on Spark and only these aggregates, one row for each pattern, come to the driver.
    """
    docs = _keyed(docs, id_col, sources, seed)
    sums = docs.groupBy("__pattern").agg(F.sum(size).cast("long").alias("tokens"), F.first(sources).alias("names"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()  # one row for each membership pattern
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns: merge rare sources first")
    digits = max(3, math.ceil(math.log(max(1, sum(r["n"] for r in sums) / RANGE_DOCS), 16)))
    docs = docs.withColumn("__range", F.substring("__order", 1, digits))
    key = lambda s: (s is None, s if s is not None else "")
    pattern = {r["__pattern"]: tuple(sorted(set(r["names"] or ()), key=key)) for r in sums}
    capacity: dict[tuple, int] = {}
    for r in sums:
        capacity[pattern[r["__pattern"]]] = capacity.get(pattern[r["__pattern"]], 0) + (r["tokens"] or 0)
    names = sorted({s for p in capacity for s in p}, key=key)
    sizes = dict.fromkeys(names, 0)
    for p, c in capacity.items():
        for s in p:
            sizes[s] += c
    source_size = [sizes[s] for s in names]
    target = targets(source_size, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))], max_passes)
    routed = flow(capacity, {s: round(t) for s, t in zip(names, target)}, max_passes)

    # Of each pattern: how many full passes, and the tokens of the last, partial one.
    rows = [(k, *(divmod(sum(routed[p].values()), capacity[p]) if capacity[p] else (0, 0))) for k, p in pattern.items()]
    full = small(docs.sparkSession, rows, "__pattern string, __full long, __rest long")
    ranges = docs.groupBy("__pattern", "__range").agg(F.sum(size).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("__pattern").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("__before", before).join(full, "__pattern")  # a row for each pattern and range
    split = written(ranges.where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("s") > F.col("__rest"))).select("__pattern", "__range", "__before", "__rest"), "mix-ranges")
    inside = docs.join(split, ["__pattern", "__range"])  # one range of each pattern
    running = F.sum(size).over(Window.partitionBy("__pattern").orderBy("__order", id_col, size).rowsBetween(Window.unboundedPreceding, -1))
    # Documents are taken up to the one in which the remainder ends, and that one if over half of it fits.
    inside = inside.where(F.col(size) > 0).withColumn("__b", F.col("__before") + F.coalesce(running, F.lit(0))).where(2 * F.col("__b") + F.col(size) <= 2 * F.col("__rest"))
    last = inside.groupBy("__pattern").agg(F.max(F.struct("__order", F.col(id_col).alias("id"), F.col(size).alias("size"))).alias("__last"))
    plan = full.join(split.select("__pattern", F.col("__range").alias("__split")), "__pattern", "left").join(last, "__pattern", "left").drop("__rest")
    return written(plan, "mix-plan"), {"names": names, "sizes": sizes, "targets": dict(zip(names, target)), "flow": routed}


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", sources: str = "sources", size: str = "size", max_passes: int = MAX_PASSES, seed: str = SEED) -> DataFrame:
    """docs with passes: how often the mix takes each document. Only the plan, a row for each pattern, is joined."""
    docs = _keyed(docs, id_col, sources, seed).join(plan, "__pattern")
    within = F.struct("__order", F.col(id_col).alias("id"), F.col(size).alias("size")) <= F.col("__last")
    own = F.expr("left(__order, length(__split))")
    more = (own < F.col("__split")) | ((own == F.col("__split")) & F.coalesce(within, F.lit(False)))
    out = docs.withColumn("passes", F.least(F.col("__full") + F.coalesce(more, F.lit(False)).cast("long"), F.lit(max_passes)))
    return out.drop("__pattern", "__order", "__full", "__split", "__last")


def mixed(docs: DataFrame, **options) -> tuple[DataFrame, dict]:
    """docs (doc_id, sources, size) with passes, and the plan in numbers."""
    plan, numbers = plan_mix(docs, **options)
    return apply_mix(docs, plan, **options), numbers


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("sources", F.array("source"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = written(_sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text"), "sizes")
    out, plan = mixed(docs)
    of = small(spark, [(s, plan["sizes"][s], plan["targets"][s]) for s in plan["names"]], "__s string, source_size long, target double")
    out = out.join(of, out["source"].eqNullSafe(of["__s"]), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken. Texts are counted twice and never shuffled."""
    plan, _ = plan_mix(written(_sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes"))
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", "text", "source")
    taken = apply_mix(_sized(rows), plan).where("passes > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "passes"))).select("__row.*")


#: DuckDB SQL with the same rows.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w,
        row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3 / w, k) AS r FROM s),
q AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wsum FROM o),
f AS (SELECT min(r) AS r FROM q WHERE 3 * source_size * wsum > left_over * w),
t AS (SELECT q.source, q.source_size, CASE WHEN q.r >= coalesce(f.r, 1000000000) THEN CAST(g.left_over AS DOUBLE) / CAST(g.wsum AS DOUBLE) * w_of ELSE CAST(3 * q.source_size AS DOUBLE) END AS target
      FROM (SELECT *, CAST(w AS DOUBLE) AS w_of FROM q) q CROSS JOIN f LEFT JOIN q g ON g.r = f.r),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round_even(t.target, 0) AS BIGINT) AS routed, d.source,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || CAST(d.doc_id AS VARCHAR)), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (CASE WHEN source_size = 0 THEN 0 ELSE routed // source_size + CASE WHEN 2 * b + size <= 2 * (routed % source_size) THEN 1 ELSE 0 END END) AS BIGINT) AS taken
FROM p
"""
