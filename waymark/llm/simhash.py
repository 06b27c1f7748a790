"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made once per text and written. Equal fingerprints are one class; what follows works
on distinct fingerprints, so copies never multiply.

A table of Hamming distances to PIVOTS reference fingerprints is computed and written once for each
distinct fingerprint. By the triangle inequality two fingerprints at most RADIUS = 2 bits apart differ
by at most RADIUS in each coordinate. The join key uses both this and the bits: the fingerprints also
agree wholly on at least two of four 16-bit blocks, so each goes to six cells (a pair of blocks and
their bits) and there to its bin of distances to the first pivot (RADIUS + 1 wide), as a guest also to
the next bin: two fingerprints in reach meet in the higher one's bin. Pairs of which another coordinate
differs by more are discarded, survivors are verified by the exact distance. Bins with more than
MAX_CELL members, where pairs would grow with the square, are handled in an exact linear way: each
member is written at its 65 points within one bit, and fingerprints that share a point (65 at most do)
are linked to the least of them; two fingerprints at most 2 bits apart always share one. The result is
the same either way.

Links become components by alternating large-star and small-star steps, each a pair of joins over
edges written to the shared folder.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; fewer words
than a shingle make one shingle of all words; rows with equal ids keep their own rows; null ids have
no say in component_id unless all ids of a component are null; ties go to the least fingerprint; texts of
any length are read whole; no rows give no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import forgotten, table, written
from waymark.llm.row_filter import RowFilter

SHINGLE = 3
SEED = 42
RADIUS = 2
PIVOTS = 16
MAX_CELL = 256
_BLOCKS = 4


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits as a signed integer; bit b is 1 if over half the shingles' hashes have it."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only U+0020 and U+0009-U+000D split
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*[w[k:] for k in range(shingle)])) if len(w) >= shingle else [b" ".join(w)]
    hashes = np.fromiter((digest(p, seed) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) and hash (xxhash64 of the text) of each row, written to the shared folder."""

    def run(batches):
        for b in batches:
            found = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64()), b.column("hash")], names=["doc_id", "fp", "hash"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    return written(rows.mapInArrow(run, "doc_id long, fp long, hash long"), "fingerprints")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, the same in every run."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}", SEED)).view(np.int64)) for i in range(n)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame) -> DataFrame:
    """fp and its distances to all pivots, written."""
    return written(fps.select("fp", F.array(*[_distance(F.col("fp"), F.lit(p).cast("long")).cast("tinyint") for p in pivots()]).alias("to_pivots")), "pivots")


def cells(table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, cell, bits, bin, home: the six cells of each fingerprint, in its bin of distances to the first pivot and, as a guest, in the next bin."""
    width = 64 // _BLOCKS
    masks = [sum((1 << width) - 1 << (width * b) for b in (i, j)) for i in range(_BLOCKS) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    each = F.array(*[F.struct(F.lit(i).alias("cell"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits"), F.lit(home).alias("home")) for i, m in enumerate(signed) for home in (True, False)])
    out = table.select("fp", F.floor(F.col("to_pivots")[0] / (radius + 1)).cast("int").alias("b"), F.inline(each))
    return out.select("fp", "cell", "bits", F.when(F.col("home"), F.col("b")).otherwise(F.col("b") + 1).alias("bin"), "home")


def links(fps: DataFrame, radius: int = RADIUS, max_cell: int | None = None) -> DataFrame:
    """Edges (a, b), a < b, over distinct fingerprints fps (fp); transitively the same as all pairs within the radius (2 at most)."""
    if not 0 <= radius <= 2:
        raise ValueError("cells are exact for a radius of 0, 1 or 2")
    max_cell, keys = MAX_CELL if max_cell is None else max_cell, ["cell", "bits", "bin"]
    table = pivot_table(fps)
    own = cells(table, radius)
    size = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = written(own.join(size, keys), "cells")

    sparse = crowded.where(F.col("n") <= max_cell).join(table, "fp")
    left = sparse.select(*keys, F.col("fp").alias("a"), F.col("to_pivots").alias("ta"), F.col("home").alias("at_home"))
    right = sparse.where("home").select(*keys, F.col("fp").alias("b"), F.col("to_pivots").alias("tb"))
    apart = [F.abs(F.col("ta")[k] - F.col("tb")[k]) for k in range(PIVOTS)]
    survivors = left.join(right, keys).where((~F.col("at_home") | (F.col("a") < F.col("b"))) & (F.greatest(*apart) <= radius))
    verified = survivors.where(_distance(F.col("a"), F.col("b")) <= radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    dense = crowded.where(F.col("n") > max_cell).select("fp").distinct()
    steps = [F.lit(0).cast("long")] + ([F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)] if radius else [])
    points = dense.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(s) for s in steps])).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    by_point = points.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    if radius == 1:  # sharing a point allows 2 bits
        by_point = points.join(points.select(F.col("fp").alias("a"), "point"), "point").where((F.col("a") < F.col("fp")) & (_distance(F.col("a"), F.col("fp")) <= 1)).select("a", F.col("fp").alias("b"))
    return verified.union(by_point).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (its component's least node) for all nodes of edges (a, b longs); nodes without an edge aren't listed."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = state(edges)
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(low, "b")
        small = hung.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b")).distinct()
        last, edges = edges, written(small, "edges")
        before, now = now, state(edges)
        forgotten(last)
        if before == now:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long), hash, component_id and component (the least fp reachable) of each row of docs (doc_id, text)."""
    marked = fingerprints(docs, shingle)
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    return labelled(marked, classes, components(links(classes.select("fp"), radius)), "fp")


def labelled(marked: DataFrame, classes: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """marked with component and component_id (its least doc_id); classes: key, first (its least doc_id); linked: node, root of keys with a link."""
    roots = linked.select(F.col("node").alias("__node"), "root")
    grouped = classes.join(roots, classes[key] == roots["__node"]).select(key, "root", "first")
    best = grouped.groupBy("root").agg(F.min("first").alias("least"))
    least = grouped.join(best, "root").select(F.col(key).alias("__key"), "root", "least")
    labels = classes.join(least, classes[key] == least["__key"], "left").select(key, F.coalesce("root", key).alias("component"), F.coalesce("least", "first").alias("component_id"))
    return marked.join(written(labels, "labels"), key)  # written, so that a hot key's rows can be dealt out


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component (see first_of_each)."""
    return first_of_each(docs, near_duplicates(docs, shingle, radius))


def first_of_each(docs: DataFrame, found: DataFrame, filter_bits: int | None = None) -> DataFrame:
    """The first row of docs of each component, with docs' columns: that with the least id, then the least hash of its text.

    found: doc_id, hash (xxhash64 of the text) and component of each row. Rows with a null id stay. Rows
    are told apart by id and hash, so rows with one id and different texts are judged each by its own;
    of rows with equal ids and texts any one stays. Texts stay where they are: a Bloom filter tells the
    rows to look at, and keys tell which of these it holds by mistake (strays). Only such strays and rows
    with equal ids and texts are shuffled whole, and only where their keys outgrow a broadcast.
    """
    named = found.where("doc_id IS NOT NULL").groupBy("doc_id", "hash").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("n"))
    named = written(named, "marked")
    first = written(named.groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"), "firsts")
    gone = named.join(first, "component").where(F.struct("doc_id", "hash") != F.col("first")).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.lit(True).alias("gone"))
    twice = named.where("n > 1").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.lit(False).alias("gone"))
    marks = written(gone.union(twice.join(gone, ["__id", "__hash"], "left_anti")), "duplicates")
    rid = F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
    held = docs["doc_id"].isNotNull() & RowFilter(marks.select(F.xxhash64("__id", "__hash").alias("rid")), filter_bits).column(rid)
    is_row = lambda m: (docs["doc_id"] == m["__id"]) & (F.xxhash64(docs["text"]) == m["__hash"])
    out, maybe = docs.where(~held), docs.where(held)
    keys = maybe.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash")).distinct()
    strays = written(keys.join(marks, ["__id", "__hash"], "left_anti"), "strays")
    if not strays.isEmpty():
        out = out.union(maybe.join(strays, is_row(strays), "left_semi"))
    repeated = marks.where("NOT gone")
    if not repeated.isEmpty():
        out = out.union(maybe.join(repeated, is_row(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
