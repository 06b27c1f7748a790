"""Near-duplicate texts by SimHash fingerprints and a pivot distance table, for a similarity of word shingles.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of SIMILAR or more;
linked texts become components. Equal sets are one class, so copies never multiply.

This is the SimHash operator for that similarity. Its 64 bits can't tell it (0.8 means about ten differing
bits), so a fingerprint has WIDTH words of 64 bits over a set's distinct shingles, the first of them the
operator's. Sets of a similarity of 0.8 differ by more than RADIUS of the 256 bits with a probability
below one in a hundred million, whatever their size (five shingles against four of them are the worst), unrelated ones by about 128. At that radius neither block cells nor bins of
pivot distances can be a join key, so the cells are those of minhashes: BANDS x ROWS for each set, and
sets that agree in all ROWS of a band meet in a bucket. A similar pair misses all buckets with a
probability of (1 - 0.8^4)^24, three in a million, and with less above it. What follows is the operator's
way, each step on fewer and larger rows:

1. The table of distances to PIVOTS reference fingerprints is computed and written once for each set in a
   bucket. The pivots are members of the largest buckets, as a pivot tells sets near it from those that
   aren't: by the triangle inequality similar sets differ by at most RADIUS in each coordinate. Pairs that
   differ more, or whose sizes don't allow the similarity, are discarded, and survivors are compared by the
   exact distance of their fingerprints. Buckets of over MAX_BUCKET sets are dealt into blocks, and each two
   blocks meet under a key of their own; a process holds fingerprints and distances only. Members with a likely partner become parts (components of
   likely pairs); parts with the same sets, found in several buckets, are one.
2. Only sets of likely members are made and shuffled. Texts are read twice and never shuffled: in the
   second pass a Bloom filter of bounded size picks the rows whose sets are compared.
3. A part is verified in one process by its sets themselves (64-bit hashes of the shingles): a set is
   compared with a component's members until one is similar, so a large group of copies takes a comparison a
   set, and only links that join components come out. Parts of over MAX_HASHES hashes are dealt into blocks by
   that number, so a process holds two blocks (one set's excess besides) whatever the texts' length.

Buckets of up to FEW sets take the same steps in pairs instead of parts. Classes, components and the choice
of rows are the operator's.

Defined cases: null and blank texts are equal; fewer words than a shingle make one shingle of all words;
letters A-Z count as a-z; null ids as in simhash; repeated rows are one set; texts of any length are read
whole, and one text's set is the least a process holds; no rows give no rows; columns other than doc_id and
text are ignored here and kept by deduplicated().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import written
from waymark.llm.key_filter import passing
from waymark.llm.row_filter import RowFilter
from waymark.llm.simhash import components, first_of_each, labelled

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
MAX_BUCKET, FEW = 1024, 8
#: Words of a fingerprint, the bits by which those of similar sets differ at most, and reference fingerprints.
WIDTH, RADIUS, PIVOTS = 4, 88, 16
#: Hashes in a block of a part: 16 MB.
MAX_HASHES = 1 << 21
SEED = 42
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_WORD_FACTORS = _rng.integers(1, 2**63, WIDTH - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES, _STEPS = np.uint64(0x0101010101010101), np.arange(8, dtype=np.uint64)[:, None]


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted (uint64)."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = map(b" ".join, zip(*[w[k:] for k in range(shingle)])) if len(w) >= shingle else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 256):
        mixed = (hashes[None, i : i + 256] ^ _MASKS[:, None]) * _FACTORS[:, None]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))
    return least


def buckets_of(least: np.ndarray) -> list[int]:
    """A value for each band: sets with the same value in a band meet."""
    return [int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes(), k)).view(np.int64)) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def majority(hashes: np.ndarray) -> int:
    """64 bits: one is 1 if over half the hashes have it."""
    ones = np.zeros((8, 8), np.int64)
    for i in range(0, len(hashes), 255):  # a byte counts a bit of 255 hashes
        ones += (hashes[i : i + 255] >> _STEPS & _LANES).sum(axis=1, dtype=np.uint64).astype("<u8").view(np.uint8).reshape(8, 8)
    return int(np.packbits(2 * ones.T.ravel() > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> bytes:
    """The SimHash of a set: WIDTH words, of the hashes themselves and of what WIDTH - 1 factors make of them."""
    mixed = [m ^ (m >> np.uint64(29)) for m in (hashes * f for f in _WORD_FACTORS)]
    return np.array([majority(h) for h in (hashes, *mixed)], "<u8").tobytes()


def fingerprints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDTH)


def to_pivots(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to the pivots; 256 counts as 255, which leaves no similar pair out."""
    return np.minimum(np.bitwise_count(fp[:, None] ^ pivots[None]).sum(axis=2, dtype=np.int64), 255).astype(np.uint8)


def marks(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Bytes: a row's fingerprint, then its distances to the pivots."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), len(rows[0]) if rows else 8 * WIDTH)


def distances(mark_a: np.ndarray, mark_b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(mark_a[..., : 8 * WIDTH] ^ mark_b[..., : 8 * WIDTH]).sum(axis=-1, dtype=np.int64)


def may_be_similar(mark_a: np.ndarray, size_a: np.ndarray, mark_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Of rows a and b, one for one or all against a single b."""
    held = np.minimum(size_a, size_b) >= SIMILAR * np.maximum(size_a, size_b)
    other = lambda at: mark_b if mark_b.ndim == 1 else mark_b[at]
    at = np.flatnonzero(held)
    apart = np.abs(mark_a[at, 8 * WIDTH :].astype(np.int16) - other(at)[..., 8 * WIDTH :]).max(axis=-1, initial=0)
    near = at[apart <= RADIUS]  # the triangle inequality
    near = near[distances(mark_a[near], other(near)) <= RADIUS]
    out = np.zeros(len(held), bool)
    out[near] = True
    return out


def likely_parts(mark: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The part of each member (the place of one of its members): components of likely pairs."""
    part = np.arange(len(sizes))
    for x in range(1, len(sizes)):
        met = np.unique(part[:x][may_be_similar(mark[:x], sizes[:x], mark[x], sizes[x])])
        if len(met):
            part[: x + 1][np.isin(part[: x + 1], met)] = met[0]
            part[x] = met[0]
    return part


def joined(keys: list[int], sets: list[np.ndarray], mark: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of keys that join the sets (sorted, distinct hashes) to the same components as all similar pairs."""
    sizes = np.array([len(x) for x in sets])
    group = np.arange(len(keys))
    edges = []
    for x in range(1, len(keys)):
        likely = np.flatnonzero(may_be_similar(mark[:x], sizes[:x], mark[x], sizes[x]))
        likely = likely[np.argsort(distances(mark[likely], mark[x]), kind="stable")]
        while len(likely):
            y, likely = likely[0], likely[1:]
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= SIMILAR * (sizes[x] + sizes[y] - both):
                edges.append((keys[y], keys[x]))
                likely = likely[group[likely] != group[y]]
                group[: x + 1][group[: x + 1] == group[y]] = group[x]
    return edges


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows (with key) for each two blocks i <= j that hold them: every two rows of a bucket meet in one at least."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    rows = rows.withColumn("other", F.explode(others))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "block", "other")


def row_id() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def shared_bands(kinds: DataFrame) -> DataFrame:
    """band, value, key and n of buckets with n > 1 sets; of buckets with the same sets, one."""
    own = kinds.select("key", F.posexplode("bands").alias("band", "value"))
    members = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"m{k}") for k in range(2)]
    size = own.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    size = size.groupBy("n", "m0", "m1").agg(F.min(F.struct("band", "value")).alias("x")).select("x.band", "x.value", "n")
    size = written(size, "bucket-sizes")
    bucket = F.xxhash64("band", "value")
    return written(passing(own, bucket, size.select(bucket.alias("bucket"))).join(size, ["band", "value"]), "shared-bands")


def pivot_table(shared: DataFrame, kinds: DataFrame, n_pivots: int = PIVOTS) -> DataFrame:
    """key, size, mark (fingerprint and its distances to all pivots) of each set in a bucket, written."""
    largest = shared.groupBy("band", "value").agg(F.max("n").alias("n"), F.min("key").alias("key")).groupBy("key").agg(F.max("n").alias("n"))
    chosen = largest.orderBy(F.desc("n"), "key").limit(n_pivots)
    pivots = np.array([np.frombuffer(r.fp, np.uint64) for r in kinds.join(F.broadcast(chosen), "key").select("fp").collect()], np.uint64).reshape(-1, WIDTH)  # n_pivots rows

    def run(batches):
        for b in batches:
            fp = fingerprints(b.column("fp"))
            mark = np.concatenate([fp.view(np.uint8).reshape(len(fp), 8 * WIDTH), to_pivots(fp, pivots)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("size"), pa.array([x.tobytes() for x in mark], pa.binary())], names=["key", "size", "mark"])

    rows = passing(kinds.select("key", "size", "fp"), F.col("key"), shared.select("key").distinct())
    return written(rows.mapInArrow(run, "key long, size long, mark binary"), "pivots")


def likely_pairs(rows: DataFrame) -> DataFrame:
    """a, b: the likely pairs of small buckets. rows: band, value, key, size, mark."""

    def run(batches):
        for b in batches:
            held = may_be_similar(marks(b.column("mark_a")), b.column("size_a").to_numpy(), marks(b.column("mark_b")), b.column("size_b").to_numpy())
            yield b.select(["a", "b"]).filter(pa.array(held))

    each = rows.groupBy("band", "value").agg(F.collect_list(F.struct("key", "size", "mark")).alias("m"))
    each = each.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y")).where("x.key < y.key")
    each = each.selectExpr("x.key a", "x.size size_a", "x.mark mark_a", "y.key b", "y.size size_b", "y.mark mark_b")
    return each.mapInArrow(run, "a long, b long").distinct()


def likely_members(rows: DataFrame, max_bucket: int, max_hashes: int) -> DataFrame:
    """part (its members' digest), blocks, key, mark: the members of large buckets with a likely partner. rows: band, value, n, key, size, mark."""

    def run(group: pa.Table) -> pa.Table:
        keys, sizes, mark = group.column("key").to_numpy(), group.column("size").to_numpy(), marks(group.column("mark"))
        order = np.argsort(keys)
        keys, sizes, mark = keys[order], sizes[order], mark[order]
        found = likely_parts(mark, sizes)
        names, blocks, taken = [], [], []
        for p, n in zip(*np.unique(found, return_counts=True)):
            if n > 1:
                at = np.flatnonzero(found == p)
                names += [xxhash.xxh3_128_digest(keys[at].tobytes(), SEED)] * n
                blocks += [int(-(-sizes[at].sum() // max_hashes))] * n
                taken.append(at)
        at = np.concatenate(taken) if taken else np.zeros(0, int)
        return pa.table([pa.array(names, pa.binary()), pa.array(blocks, pa.int32()), pa.array(keys[at]), pa.array([x.tobytes() for x in mark[at]], pa.binary())], names=["part", "blocks", "key", "mark"])

    dealt = in_blocks(rows, F.ceil(F.col("n") / max_bucket)).select("band", "value", "i", "j", "key", "size", "mark")
    return dealt.groupBy("band", "value", "i", "j").applyInArrow(run, "part binary, blocks int, key long, mark binary").dropDuplicates(["part", "key"])


def links(docs: DataFrame, kinds: DataFrame, max_bucket: int = MAX_BUCKET, few: int = FEW, max_hashes: int = MAX_HASHES) -> DataFrame:
    """Edges (a, b) over set keys; transitively all similar pairs of candidates. kinds: a row for each set, see near_duplicates()."""
    shared = shared_bands(kinds)
    shared = shared.join(pivot_table(shared, kinds), "key")
    pairs = written(likely_pairs(shared.where(F.col("n") <= few)), "likely-pairs")
    members = written(likely_members(shared.where(F.col("n") > few), max_bucket, max_hashes), "likely-members")

    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(members.select("key")).distinct()
    wanted_rows = RowFilter(kinds.select("key", "rid").join(wanted, "key").select("rid"))  # one row of each set

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(wanted_rows.holds(b.column("rid").to_numpy())))
            for i in range(0, b.num_rows, 100):
                found = [shingles(t) for t in b.column("text").slice(i, 100).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(h) for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["key", "hashes"])

    sets = docs.select(row_id().alias("rid"), "text").mapInArrow(run, "key long, hashes array<long>")
    sets = written(sets, "shingle-sets").dropDuplicates(["key"])  # by the joins' own shuffle

    near = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb")), "b")
    both, every = F.size(F.array_intersect("ha", "hb")), F.size("ha") + F.size("hb")
    near = near.where(both >= SIMILAR * (every - both)).select("a", "b")

    def compare(group: pa.Table) -> pa.Table:
        sets_of = [np.asarray(x.values).view(np.uint64) for c in group.column("hashes").chunks for x in c]
        edges = joined(group.column("key").to_pylist(), sets_of, marks(group.column("mark")))
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    met = in_blocks(members, F.col("blocks")).join(sets, "key")
    return near.union(met.groupBy("part", "i", "j").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, max_bucket: int = MAX_BUCKET, few: int = FEW, max_hashes: int = MAX_HASHES) -> DataFrame:
    """doc_id, hash (xxhash64 of the text), component_id and component (the least set key reachable) of each row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 100):  # a process holds the sets of 100 texts
                part = b.slice(i, 100)
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                least = [minhashes(h) for h in sets]
                made = [
                    pa.array([set_key(h) for h in sets], pa.int64()),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([fingerprint_of(h) for h in sets], pa.binary()),
                    pa.array([buckets_of(x) for x in least], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "hash", "rid")), *made], names=["doc_id", "hash", "rid", "key", "size", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), row_id().alias("rid"), "text")
    marked = written(rows.mapInArrow(run, "doc_id long, hash long, rid long, key long, size long, fp binary, bands array<long>"), "minhashes")
    kinds = written(marked.select("key", "rid", "size", "fp", "bands").dropDuplicates(["key"]), "sets")
    classes = written(marked.groupBy("key").agg(F.min("doc_id").alias("first")), "set-classes")
    return labelled(marked.select("doc_id", "hash", "key"), classes, components(links(docs, kinds, max_bucket, few, max_hashes)), "key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each component (see simhash.first_of_each)."""
    return first_of_each(docs, near_duplicates(docs))
