"""Scoring texts with context-tree weighting over binary-decomposed bytes.

A text is modelled as its lower-cased words joined by one blank and closed by a line feed. Each byte
is eight binary decisions; a decision is predicted from its bit prefix and the DEPTH bytes before, and
every context length has a Krichevsky-Trofimov estimate. A node's weight is its own KT block
probability against the product of its children's weighted probabilities (half and half a priori);
a prediction mixes all depths along the path with these weights. Where the training texts have no
such context, the next shorter one predicts.

Counts cover all training texts and are as large as the corpus makes them. Texts are dealt to blocks of
about BLOCK_BYTES and stream through Python in batches. What a block needs (its distinct keys of
context and byte, its distinct words) leaves it packed, one row for each part of the key space; a part
holds whole contexts of two bytes. Parts are merged over all blocks (over groups of blocks first, so
that a common context is not summed in one task), their trees are weighted, a few whole contexts at a
time, and the answers go back to the blocks packed likewise. The contexts of one byte and the root are
summed to 65,280 rows at most and sent to all. Nothing that grows with the corpus is broadcast,
collected or held in one group; a process holds a block's keys and words, or a part's.

Defined cases: null text is empty: its only token is the end; without training texts every decision
has probability 1/2; rows with equal ids and texts lie in one block and are scored alike; null ids
count as the empty text in the crc32 fold; a text longer than a block is a block of its own; no rows
give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import id_crc, table, written

DEPTH = 5
BLOCK_BYTES = 24 << 20
#: Bytes of text for each part of the key space, and blocks whose rows are merged first.
PART_BYTES, MERGED_BLOCKS = 64 << 20, 512
#: Keys that are weighted at a time (whole contexts of two bytes).
TREE_ROWS = 200_000
KEYS, WORDS, TEXTS = 0, 1, 2
END = b"\n"
_LN10, _LN_HALF = math.log(10), math.log(0.5)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of a block with these counts."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def keys_of(data: np.ndarray, depth: int) -> np.ndarray:
    """For each byte after the first depth ones: the bytes before it, latest highest, then itself."""
    n = len(data) - depth
    wide = data.astype(np.uint64)
    out = wide[depth:].copy()
    for k in range(1, depth + 1):
        out |= wide[depth - k : depth - k + n] << np.uint64(8 * (depth + 1 - k))
    return out


def _streams(texts: list[list[bytes]], depth: int, size: int = 1 << 20):
    """Yields (keys, lengths) of runs of texts, about size bytes each."""
    pad, parts, lengths, held = END * depth, [], [], 0

    def keys():
        data = np.frombuffer(b"".join(pad + p for p in parts), np.uint8)
        all_keys = keys_of(data, depth)
        inside = np.ones(len(data), bool)
        starts = np.cumsum([0, *[n + depth for n in lengths[:-1]]])
        for k in range(depth):
            inside[starts + k] = False
        return all_keys[inside[depth:]], np.array(lengths)

    for words in texts:
        parts.append(b" ".join(words) + END)
        lengths.append(len(parts[-1]))
        held += lengths[-1]
        if held >= size:
            yield keys()
            parts, lengths, held = [], [], 0
    if parts:
        yield keys()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else order
    return keys[starts], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], starts) if len(keys) else np.empty(0, np.int64)


def _slices(texts: pa.Array | pa.ChunkedArray, size: int = 2 << 20):
    """The texts in lists of about size bytes, so that a block is never held as Python objects."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size)) + 1
        yield texts.slice(start, stop - start).to_pylist()
        start = stop


_PACKED = "kind int, part int, blk int, keys binary, counts binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=["kind", "part", "blk", "keys", "counts"])


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint64), dtype=np.uint64)


def _runs(batches, *names: str):
    """(values of the columns names, slice of a batch) for each run of rows with the same values."""
    for b in batches:
        columns = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        new = np.ones(b.num_rows, bool)
        if b.num_rows:
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.nonzero(new)[0].tolist()
        for i, j in zip(starts, [*starts[1:], b.num_rows]):
            yield tuple(int(c[i]) for c in columns), b.slice(i, j - i)


class _Block:
    """A block's distinct keys and words with their counts in its training texts; the end is the empty word."""

    def __init__(self, blk: int, depth: int):
        self.blk, self.depth, self.words, self.parts, self.held = blk, depth, Counter(), [], 0

    def add(self, texts: pa.Array, train: bool) -> None:
        for part in _slices(texts):
            split = [tokens(t) for t in part]
            seen = Counter(chain.from_iterable(split))
            seen[b""] = len(split)
            self.words.update(seen if train else dict.fromkeys(seen, 0))
            for keys, _ in _streams(split, self.depth):
                found, counts = np.unique(keys, return_counts=True)
                self.parts.append((found, counts * train))
                self.held += len(found)
                if self.held > 1_250_000:
                    self.parts = [_merged(self.parts)]
                    self.held = len(self.parts[0][0])

    def rows(self, parts: int):
        keys, counts = _merged(self.parts)
        self.parts = []
        part = ((keys >> np.uint64(8 * (self.depth - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        for p in range(parts):
            if len(at := order[edges[p] : edges[p + 1]]):
                yield _packed([(KEYS, p, self.blk, _pack(keys[at]), counts[at].astype("<i8").tobytes())])
        by_part: dict[int, list[bytes]] = {}
        for w in self.words:
            by_part.setdefault(xxhash.xxh32_intdigest(w) % parts, []).append(w)
        for p, words in by_part.items():
            yield _packed([(WORDS, p, self.blk, END.join(words), np.array([self.words[w] for w in words], "<i8").tobytes())])


def _facts(batches, depth: int, parts: int):
    """The packed rows of each block, from rows (blk, text, train) that come block by block."""
    own = None
    for (blk, train), b in _runs(batches, "blk", "train"):
        if own is None or own.blk != blk:
            if own:
                yield from own.rows(parts)
            own = _Block(blk, depth)
        own.add(b.column("text"), bool(train))
    if own:
        yield from own.rows(parts)


def _sums(batches):
    """Packed rows with the same kind and part, which come one after another, as one row with their blocks' sums."""
    at, parts, held, words = None, [], 0, {}

    def row():
        if at[0] == KEYS:
            keys, counts = _merged(parts)
            return _packed([(*at, 0, _pack(keys), counts.astype("<i8").tobytes())])
        return _packed([(*at, 0, END.join(words), np.fromiter(words.values(), "<i8", len(words)).tobytes())])

    for now, b in _runs(batches, "kind", "part"):
        if at is not None and now != at:
            yield row()
            parts, held, words = [], 0, {}
        at = now
        for keys, counts in zip(b.column("keys"), b.column("counts")):
            n = np.frombuffer(counts.as_py(), "<i8")
            if at[0] == KEYS:
                parts.append((_unpack(keys.as_py()), n))
                held += len(n)
                if held > 1_250_000:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
            else:
                own = keys.as_py().split(END)
                words.update(zip(own, map(sum, zip(map(words.get, own, repeat(0)), n.tolist()))))
    if at is not None:
        yield row()


class Levels:
    """The nodes of depths least to depth over sorted keys with counts, weighted from the leaves up."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, least: int = 2):
        self.keys, self.depth, self.least = keys, depth, least
        low = np.uint64(0xFF)
        rows, n, self.row_of, self.nodes, child = keys, counts.astype(np.float64), {}, {}, None
        at = np.arange(len(keys))
        for d in range(depth, least - 1, -1):
            if d < depth:
                parent, of = np.unique((rows >> np.uint64(16) << np.uint64(8)) | (rows & low), return_inverse=True)
                at, n, below_to_row = of[at], np.bincount(of, n, len(parent)), of
                rows = parent
            self.row_of[d], nodes = at, []
            for j in range(8):
                group = rows >> np.uint64(8 - j)
                new = np.ones(len(rows), bool)
                new[1:] = group[1:] != group[:-1]
                starts = np.nonzero(new)[0]
                index = np.cumsum(new) - 1
                bit = (rows >> np.uint64(7 - j)) & np.uint64(1)
                n1 = np.add.reduceat(n * bit, starts)
                n0 = np.add.reduceat(n * (1 - bit.astype(np.float64)), starts)
                own = kt_log(n0, n1)
                if d == depth:
                    weighted, weight = own, np.ones(len(own))
                else:
                    prior = child[j]
                    to = index[below_to_row[prior["starts"]]]
                    weighted = _LN_HALF + np.logaddexp(own, np.bincount(to, prior["weighted"], len(own)))
                    weight = np.exp(_LN_HALF + own - weighted)
                nodes.append({"starts": starts, "index": index, "n0": n0, "n1": n1, "weighted": weighted, "weight": weight, "prefix": group[starts]})
            self.nodes[d], child = nodes, nodes

    def tops(self):
        """For the nodes of the least depth (2): last byte, bit prefix with its leading 1, n0, n1, weighted."""
        for j, x in enumerate(self.nodes[self.least]):
            prefix = (x["prefix"] & np.uint64((1 << j) - 1)).astype(np.int64) | (1 << j)
            yield (x["prefix"] >> np.uint64(8 * (self.least - 1) + j)).astype(np.int64), prefix, x["n0"], x["n1"], x["weighted"]

    def log10(self, upper: Upper) -> np.ndarray:
        """log10 probability of each key's byte in its context."""
        out = np.zeros(len(self.keys))
        byte = (self.keys & np.uint64(0xFF)).astype(np.int64)
        last = (self.keys >> np.uint64(8 * self.depth)).astype(np.int64)
        for j in range(8):
            bit = (byte >> (7 - j)) & 1
            p = np.full(len(self.keys), np.nan)
            for d in range(self.depth, self.least - 1, -1):
                x = self.nodes[d][j]
                k = x["index"][self.row_of[d]]
                p = _mix(p, np.where(bit == 1, x["n1"][k], x["n0"][k]), x["n0"][k] + x["n1"][k], x["weight"][k])
            m = (byte >> (8 - j)) | (1 << j)
            for counts, weight in ((upper.counts[last, m], upper.weights[last, m]), (upper.root_counts[m], upper.root_weights[m])):
                p = _mix(p, np.where(bit == 1, counts[:, 1], counts[:, 0]), counts.sum(axis=1), weight)
            out += np.log(np.where(np.isnan(p), 0.5, p))
        return out / _LN10


def _mix(p, own, total, weight):
    """The next shorter context's say: p (nan: no longer context was seen) mixed with this node's KT estimate; unseen nodes say nothing."""
    kt = (own + 0.5) / (total + 1.0)
    return np.where(total > 0, np.where(np.isnan(p), kt, weight * kt + (1 - weight) * p), p)


class Upper:
    """Counts and weights of the contexts of one byte and of the root."""

    def __init__(self, rows):
        """rows: (last byte, bit prefix, n0, n1, sum of the children's weighted logs)."""
        self.counts, below = np.zeros((256, 256, 2)), np.zeros((256, 256))
        for c, m, n0, n1, s in rows:
            self.counts[c, m], below[c, m] = (n0, n1), s
        own = kt_log(self.counts[..., 0], self.counts[..., 1])
        weighted = _LN_HALF + np.logaddexp(own, below)
        self.weights = np.exp(_LN_HALF + own - weighted)
        self.root_counts = self.counts.sum(axis=0)
        own = kt_log(self.root_counts[:, 0], self.root_counts[:, 1])
        self.root_weights = np.exp(_LN_HALF + own - (_LN_HALF + np.logaddexp(own, weighted.sum(axis=0))))


def _trees(keys: np.ndarray, counts: np.ndarray, depth: int):
    """Levels over runs of whole contexts of two bytes, of TREE_ROWS keys or one context each."""
    two = keys >> np.uint64(8 * (depth - 1))
    ends, start = [*(np.nonzero(two[1:] != two[:-1])[0] + 1).tolist(), len(keys)], 0
    for end, after in zip(ends, [*ends[1:], None]):
        if after is None or after - start > TREE_ROWS:
            yield Levels(keys[start:end], counts[start:end], depth)
            start = end


def answers(sums: DataFrame, depth: int) -> DataFrame:
    """Rows (kind, part, keys, values): log10 probability of each key (4-byte floats), training count of each word. sums: a row for each kind and part."""
    spark = sums.sparkSession

    def tops(batches):
        for b in batches:
            for keys, counts in zip(b.column("keys"), b.column("counts")):
                for levels in _trees(_unpack(keys.as_py()), np.frombuffer(counts.as_py(), "<i8"), depth):
                    for c, m, n0, n1, s in levels.tops():
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c, m, n0, n1, s)], names=["c", "m", "n0", "n1", "s"])

    found = sums.where(F.col("kind") == KEYS).mapInArrow(tops, "c long, m long, n0 double, n1 double, s double").groupBy("c", "m").agg(F.sum("n0"), F.sum("n1"), F.sum("s"))
    upper = spark.sparkContext.broadcast(Upper(found.collect()))  # 256 * 255 rows at most

    def score(batches):
        for b in batches:
            for kind, part, keys, counts in zip(*(b.column(c) for c in ("kind", "part", "keys", "counts"))):
                values = counts.as_py()
                if kind.as_py() == KEYS:
                    values = b"".join(x.log10(upper.value).astype("<f4").tobytes() for x in _trees(_unpack(keys.as_py()), np.frombuffer(values, "<i8"), depth))
                yield pa.RecordBatch.from_arrays([pa.array([kind.as_py()], pa.int32()), pa.array([part.as_py()], pa.int32()), pa.array([keys.as_py()], pa.binary()), pa.array([values], pa.binary())], names=["kind", "part", "keys", "values"])

    return written(sums.mapInArrow(score, "kind int, part int, keys binary, values binary"), "lm-answers")


def _answered(batches):
    """For each block's packed keys the values of those keys; the row with all keys of a part comes before the blocks' rows."""
    keys = values = None
    for (kind, _, _), b in _runs(batches, "kind", "part", "share"):
        for own, blk, of in zip(b.column("keys"), b.column("blk"), b.column("values")):
            own, blk = own.as_py(), blk.as_py()
            if blk < 0:
                keys, values = (_unpack(own), np.frombuffer(of.as_py(), "<f4")) if kind == KEYS else (pa.array(own.split(END), pa.binary()), np.frombuffer(of.as_py(), "<i8"))
                continue
            at = np.searchsorted(keys, _unpack(own)) if kind == KEYS else pc.index_in(pa.array(own.split(END), pa.binary()), value_set=keys).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([kind], pa.int32()), pa.array([own], pa.binary()), pa.array([values[at].tobytes()], pa.binary())], names=["blk", "kind", "keys", "values"])


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_bytes", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(batches, depth: int, total: int, distinct: int):
    """Scores of texts that come block by block, each block after its keys and words."""
    blk, parts, keys = None, {KEYS: [], WORDS: []}, None
    below = math.log10(total + 0.1 * (distinct + 1))
    unknown = -1.0 - below + 1e-9  # a word without a count
    for (now, kind), b in _runs(batches, "blk", "kind"):
        if now != blk:
            blk, parts, keys = now, {KEYS: [], WORDS: []}, None
        if kind != TEXTS:
            parts[kind] += [(k.as_py(), v.as_py()) for k, v in zip(b.column("keys"), b.column("values"))]
            continue
        if keys is None:
            keys = np.concatenate([_unpack(k) for k, _ in parts[KEYS]])
            order = np.argsort(keys)
            keys, values = keys[order], np.concatenate([np.frombuffer(v, "<f4") for _, v in parts[KEYS]])[order].astype(np.float64)
            vocabulary = pa.concat_arrays([pa.array(k.split(END), pa.binary()) for k, _ in parts[WORDS]])
            logs = np.log10(np.concatenate([np.frombuffer(v, "<i8") for _, v in parts[WORDS]]) + 0.1) - below
            parts = {KEYS: [], WORDS: []}
        ids, at = b.column("doc_id"), 0
        for part in _slices(b.column("text")):
            texts = [tokens(t) for t in part]
            each = logs[pc.index_in(pa.array(chain.from_iterable([*t, b""] for t in texts), pa.binary()), value_set=vocabulary).to_numpy()]
            n = np.array([len(t) + 1 for t in texts])
            starts = np.cumsum([0, *n[:-1].tolist()])
            scores, n_bytes = [], []
            for own_keys, lengths in _streams(texts, depth):
                order = np.argsort(own_keys)  # sorted look-ups stay in the cache
                found = np.empty(len(order))
                found[order] = values[np.searchsorted(keys, own_keys[order])]
                scores.append(np.add.reduceat(found, np.cumsum([0, *lengths[:-1].tolist()])))
                n_bytes.append(lengths)
            columns = [n, np.add.reduceat((each > unknown).astype(np.int64), starts), np.concatenate(n_bytes), np.add.reduceat(each, starts), np.concatenate(scores)]
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), *[pa.array(c, f.type) for c, f in zip(columns, list(_SCORES)[1:])]], schema=_SCORES)
            at += len(texts)


def scored(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, merged_blocks: int = MERGED_BLOCKS) -> DataFrame:
    """doc_id, n_tokens, n_known, n_bytes, base_score, score, bits_per_byte, train_tokens of each row of docs (doc_id, text, train boolean)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("train", F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-size // block_bytes)), max(1, -(-size // part_bytes))
    groups = max(1, -(-blocks // merged_blocks))
    docs = docs.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    dealt = docs.select("blk", "text", F.col("train").cast("int").alias("train")).repartitionById(blocks, "blk").sortWithinPartitions("blk", "train")
    facts = written(dealt.mapInArrow(lambda b: _facts(b, depth, parts), _PACKED), "lm-facts")
    sums = facts.withColumn("share", F.pmod("blk", F.lit(groups)))
    for by in (["kind", "part", "share"], ["kind", "part"])[groups == 1 :]:
        sums = sums.repartition(*by).sortWithinPartitions(*by).select("kind", "part", "blk", "keys", "counts").mapInArrow(_sums, _PACKED)
    sums = written(sums, "lm-sums")

    def counted(batches):
        for b in batches:
            n = [np.frombuffer(c.as_py(), "<i8") for c in b.column("counts")]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([np.count_nonzero(x) for x in n], pa.int64())], names=["n", "v"])

    total, distinct = sums.where(F.col("kind") == WORDS).mapInArrow(counted, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    table = answers(sums, depth).select("kind", "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("share"), F.lit(-1).alias("blk"), "keys", "values")
    asked = facts.select("kind", "part", F.pmod("blk", F.lit(groups)).alias("share"), "blk", "keys", F.lit(None).cast("binary").alias("values"))
    both = table.union(asked).repartition("kind", "part", "share").sortWithinPartitions("kind", "part", "share", "blk")
    back = both.mapInArrow(_answered, "blk int, kind int, keys binary, values binary")
    no_id, no_text, no_data = F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("binary")
    rows = back.select("blk", "kind", "keys", "values", no_id.alias("doc_id"), no_text.alias("text"))
    rows = rows.union(docs.select("blk", F.lit(TEXTS), no_data, no_data, "doc_id", "text")).repartitionById(blocks, "blk").sortWithinPartitions("blk", "kind")
    out = rows.mapInArrow(lambda b: _scores(b, depth, total, distinct), "doc_id long, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    return out.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).withColumn("train_tokens", F.lit(total).cast("long"))


def op7_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc(F.col("doc_id")) % 10 == 0
    out = scored(docs.withColumn("train", ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
