"""Prefix trie of conversations by chained digests.

Turns are shuffled once, to the conversation that opens them (base), and sorted there; a task streams over
its turns, keeps only the first turns of the current base, and chains digests: that of a prefix is the SHA-256 of the
digest before it and of the turn's role and text with their lengths. So each prefix of each conversation, the
empty one included, is a row of fixed size, and texts are shuffled once and never copied.

Prefixes are grouped by (depth, digest) into nodes, aggregated in each task first, so a first turn that most
conversations share is a few rows. Sums over subtrees: each node goes to all its ancestors, which are the
prefixes of any member, here the smallest. In a conversation of D turns that would be D * D / 2 rows; so nodes
go to their ancestors within BLOCK depths, the sums of the blocks' top nodes go up the trie of tops in the same way, and
from there to the ancestors in the block above: some BLOCK * D rows.

The hash over the ids that end at a node takes them in order, however many: ids are sorted by ranges over
all tasks, runs of ids become pieces of text, and the pieces of a node stream through one hash.

Defined cases: turns without conv_id belong to no conversation; null turns come first; turns with equal numbers are
ordered by role and text; null role or text is the empty text; texts of any length are read whole; no turns give
no nodes; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import table, written

BLOCK = 32
#: Characters of a piece of joined ids.
PIECE = 1 << 16
ROOT = hashlib.sha256(b"").digest()
_SIZES = struct.Struct("<QQ")


def chained(before: bytes, role: bytes, text: bytes) -> bytes:
    h = hashlib.sha256(before + _SIZES.pack(len(role), len(text)))
    h.update(role)
    h.update(text)
    return h.digest()


def opening(conv_id: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % 4


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent (digest; null for the root), words and is_end of each prefix of each rebuilt conversation.

    turns: conv_id, turn, role, text. A conversation is rebuilt from the first turns of its base, conv_id - conv_id % 20, and its own after as many.
    """

    def run(batches):
        base, head = None, []  # the base whose turns are kept, and its first turns
        conv, depth, seen, digest, last = None, 0, 0, ROOT, None
        out: list[tuple] = []

        def flushed(rows):
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "depth", "digest", "parent", "words", "is_end"])

        for b in batches:
            for c, at, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "base", "role", "text"))):
                if at != base:
                    base, head = at, []
                role, text = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                if c != conv:
                    if last:
                        out.append((*last, True))
                    conv, skip, seen, depth, digest = c, opening(c), 0, 0, ROOT
                    last = (c, 0, ROOT, None, 0)
                    for turn in () if c == at else head[:skip]:
                        out.append((*last, False))
                        before, digest, depth = digest, chained(digest, *turn), depth + 1
                        last = (c, depth, digest, before, len(turn[1].split()))
                if c == at and len(head) < 3:
                    head.append((role, text))
                seen += 1
                if seen > skip or c == at:  # a base opens with its own turns
                    out.append((*last, False))
                    before, digest, depth = digest, chained(digest, role, text), depth + 1
                    last = (c, depth, digest, before, len(text.split()))
                if len(out) >= 20_000:
                    yield flushed(out)
                    out = []
        if last:
            out.append((*last, True))
        if out:
            yield flushed(out)

    conv = F.col("conv_id").cast("long")
    rows = turns.where("conv_id IS NOT NULL").select(conv.alias("conv_id"), (conv - conv % 20).alias("base"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, words long, is_end boolean")


def subtree_sums(nodes: DataFrame, paths: DataFrame, sums: list[str], block: int = BLOCK) -> DataFrame:
    """digest and, for each column of sums, its total over the node's subtree, the node included.

    nodes: conv_id (a member), depth, digest and sums; paths: conv_id, depth, digest of the prefixes of these members at least.
    """
    paths = paths.select(F.col("conv_id").alias("__conv"), F.col("depth").alias("__at"), F.col("digest").alias("__up"), F.floor(F.col("depth") / block).alias("__block"))

    def up(rows: DataFrame, rank) -> DataFrame:
        met = (F.col("conv_id") == F.col("__conv")) & (rank == F.col("__block")) & (F.col("__at") <= F.col("depth"))
        return rows.join(paths, met).groupBy(F.col("__up").alias("digest")).agg(*[F.sum(c).alias(c) for c in sums])

    rank = F.floor(F.col("depth") / block)
    within = up(nodes, rank)
    if (nodes.agg(F.max("depth")).first()[0] or 0) < block:
        return within
    within = written(within, "block-sums")
    tops = nodes.where(F.col("depth") % block == 0).drop(*sums).join(within, "digest")
    thin = paths.where(F.col("__at") % block == 0).select(F.col("__conv").alias("conv_id"), (F.col("__at") / block).cast("long").alias("depth"), F.col("__up").alias("digest"))
    of_tops = written(subtree_sums(tops.withColumn("depth", (F.col("depth") / block).cast("long")), thin, sums, block), "top-sums")
    below = tops.drop(*sums).where("depth > 0").join(of_tops, "digest")
    return within.unionByName(up(below, rank - 1)).groupBy("digest").agg(*[F.sum(c).alias(c) for c in sums])


def joined_hashes(ids: DataFrame, piece: int = PIECE) -> DataFrame:
    """key and sha256 (lower-case hex) of the decimal ids of each key, ascending and joined by commas. ids: key (binary), id (long), distinct."""
    shuffles = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        key, first, run, size = None, None, [], 0
        for b in batches:
            done = []
            for k, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist()):
                if k != key or size >= piece:
                    if run:
                        done.append((key, first, ",".join(run)))
                    key, first, run, size = k, i, [], 0
                run.append(str(i))
                size += len(run[-1]) + 1
            if done:
                yield batch(done)
        if run:
            yield batch([(key, first, ",".join(run))])

    def batch(rows):
        keys, firsts, texts = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["key", "first", "text"])

    def hashes(batches):
        key, h = None, None
        for b in batches:
            done = []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                if k != key:
                    if h:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(t.encode())
                else:
                    h.update(b"," + t.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["key", "sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "sha256"])

    ordered = ids.select("key", "id").repartitionByRange(shuffles, "key", "id").sortWithinPartitions("key", "id")
    runs = ordered.mapInArrow(pieces, "key binary, first long, text string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, sha256 string")


def trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: digest, parent (digest), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(prefixes(turns), "prefixes")
    by_node = rows.groupBy("depth", "digest", "parent", "words").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = written(by_node, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("__parent")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, nodes["digest"] == F.col("__parent"), "left").drop("__parent").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes-children")
    own = nodes.select("conv_id", "depth", "digest", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = written(subtree_sums(own, rows.select("conv_id", "depth", "digest"), ["n_leaves", "saved_tokens"], block), "sums")
    ends = written(joined_hashes(rows.where("is_end").select(F.col("digest").alias("key"), F.col("conv_id").alias("id"))), "ends")
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, "digest").join(ends.withColumnRenamed("key", "digest"), "digest", "left").join(parents, "parent", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("digest", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", none).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("digest", "parent")


#: DuckDB SQL with the same rows; crc32 bit by bit: each character's code, then eight steps (-1).
OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR s IN string_split(CAST(c AS VARCHAR), '')])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (SELECT convs.c, i, x FROM convs JOIN t ON t.c = convs.c - convs.c % 20 AND i <= h
  UNION ALL SELECT convs.c, i, x FROM convs JOIN t ON t.c = convs.c AND i > h),
seqs AS (SELECT convs.c, coalesce(list(x ORDER BY i) FILTER (x IS NOT NULL), []) AS s FROM convs LEFT JOIN rebuilt ON rebuilt.c = convs.c GROUP BY convs.c),
pre AS (SELECT c, d, s[1:d] AS p, len(s) AS n FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes LEFT JOIN kids USING (d, p)),
up AS (SELECT a AS d, p[1:a] AS p, n_children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own)),
sums AS (SELECT d, p, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY d, p)
SELECT own.conv_id, own.d AS depth, par.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN sums USING (d, p) LEFT JOIN nodes par ON par.d = own.d - 1 AND par.p = own.p[1:own.d - 1]
"""
