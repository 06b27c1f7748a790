"""Content-addressed store of token ids.

Texts are encoded with a public tokenizer; a rolling (gear) hash over the ids cuts each document's ids
into chunks where the hash of the last WINDOW ids has its low bits zero, so equal passages give equal
chunks wherever they stand. A chunk's address is a 128-bit BLAKE2b of its bytes.

    chunks/    digest, n (ids), payload (ids, little-endian, 2 bytes each if the vocabulary allows, else 4)
    recipes/   part, pos, doc_id, start, n_tokens, root, digests; in ascending doc_id order within and over parts
    manifest/  level, part, pos, n_docs, n_tokens, root: a Merkle tree over all documents

A unique chunk is stored once: each task sends a chunk once, and chunks meet by digest. root of a
recipe is the Merkle root over its chunk digests (pairs hashed level by level, an odd one is carried
up). The manifest's level 0 has a node for each FAN documents of a part, and each level above one for
FAN nodes of the level below, up to a single node of part -1; parts hold about PART_DOCS documents,
so no task's list grows with the corpus. Reading builds the tree anew from the recipes and compares
all nodes, verifies every chunk against its digest and every document against its root and length.
crc32 sums are taken where the chunks lie and combined along the recipe (crc32 is linear), so no
payload is moved for verification.

Texts are encoded by the tokenizers library. For byte-level vocabularies they are cut first where such
tokenizers never join anything: before single blanks (see pieces.py), and between letters and the
signs after them. Arrow finds a slice's distinct pieces; only those meet the library, and a worker
remembers the ids of up to REMEMBERED words over all its tasks. Other vocabularies get whole texts.

Defined cases: null and empty texts hold only the end id; a special token's name in a text is that
token, as in the library; repeated rows have equal recipes; rows with equal or null doc_id are stored
one after another (nulls first, then by root); a text without a cut gets a chunk each MAX_CHUNK ids;
an empty table gives an empty store; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import shared_path, small, table, written
from waymark.llm.pieces import careful

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
WINDOW = 8
MASK_BITS = 10  # 1024 ids for a chunk on average
MIN_CHUNK, MAX_CHUNK = 256, 8192
#: Ids whose rolling hashes are made at once, so that they stay in the processor's cache.
ROLLED = 1 << 14
_GEAR = np.array([int.from_bytes(hashlib.blake2b(b"gear %d" % i, digest_size=8).digest(), "little") for i in range(256)], np.uint64)


#: Documents for each part of the recipes, and nodes for each node of the manifest.
PART_DOCS, FAN = 100_000, 1024
#: Words that a worker remembers at most, in two generations (see _words).
REMEMBERED = 400_000
#: Characters of text that are encoded together.
SLICE = 5_000_000
_WHITE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
_ODD = f"^ | $|{_WHITE} | {_WHITE}"
#: Letters, then signs that no pre-token joins to letters before or after them (the apostrophe is none of them).
_WORD = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?P<signs>[!-&(-/:-@\\[-`{-~]*)$"


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies have for each byte: printing ones stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class TextEncoder:
    """Whole texts to ids with the tokenizers library (see the module's text)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.bytewise = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.id_bytes = [i.to_bytes(self.width, "little") for i in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts one after another, and how many each has."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(encoded), self.kind), list(map(len, encoded))

    def _words(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """_whole() of words after a blank: a blank and letters are one pre-token, which goes to the library's model at once.

        A word met again moves to the young generation; when that is full the old one is forgotten.
        """
        tokenize, blank, letters, of = self.tokenizer.model.tokenize, self.letters[32], self.letters, self.id_bytes
        if 2 * len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, words))
        at = [k for k, v in enumerate(found) if v is None]
        missing = [words[k] for k in at]
        values = list(map(self.old.get, missing))
        for k, v in enumerate(values):
            if v is None:
                w = missing[k]
                values[k] = b"".join([of[t.id] for t in tokenize(blank + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))])
        self.young.update(zip(missing, values))
        for k, v in zip(at, values):
            found[k] = v
        return np.frombuffer(b"".join(found), self.kind), [n // self.width for n in map(len, found)]

    def _units(self, pieces: pa.Array) -> tuple[list[tuple[np.ndarray, list[int]]], np.ndarray]:
        """Ids of words, signs and other pieces and of an empty one, and which two of them each piece is after a blank."""
        parts = pc.extract_regex(pieces, _WORD)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        words, signs = (parts.drop_null().field(k).dictionary_encode() for k in range(2))
        others = [" " + p for p in pieces.filter(pa.array(~simple)).to_pylist()]
        n, m = len(words.dictionary), len(signs.dictionary)
        of = np.full((len(pieces), 2), n + m + len(others), np.int32)
        of[simple, 0], of[simple, 1] = words.indices.to_numpy(), n + signs.indices.to_numpy()
        of[~simple, 0] = n + m + np.arange(len(others))
        return [self._words(words.dictionary.to_pylist()), self._whole(signs.dictionary.to_pylist()), self._whole(others), (np.zeros(0, self.kind), [0])], of

    def __call__(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (None: none) one after another, and where each text's begin and end."""
        texts = (texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not self.bytewise:
            ids, n = self._whole(texts.to_pylist())
            return ids, np.cumsum([0, *n])
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.split_pattern(texts, " ")
        if pc.any(odd).as_py():
            lists = pc.if_else(odd, pa.array([careful(t) if o else None for t, o in zip(texts.to_pylist(), odd.to_pylist())], pa.list_(pa.string())), lists)
        flat, offsets = lists.flatten(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
        distinct = flat.dictionary_encode()
        firsts = flat.take(pa.array(offsets[:-1])).dictionary_encode()  # these have no blank before them
        made, of = self._units(distinct.dictionary)
        units, n_units = of[distinct.indices.to_numpy()], sum(len(n) for _, n in made)
        units[offsets[:-1]] = np.stack([n_units + firsts.indices.to_numpy(), np.full(len(texts), n_units - 1)], axis=1)
        made.append(self._whole(firsts.dictionary.to_pylist()))
        known, units = np.concatenate([ids for ids, _ in made]), units.ravel()
        lengths = np.concatenate([np.array(n, np.int32) for _, n in made])
        begins = np.cumsum(lengths, dtype=np.int64) - lengths
        n = lengths[units]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.repeat((begins[units] - (ends - n)).astype(np.int32), n)  # an Arrow array has less than 2^31 bytes
        return known[at + np.arange(len(at), dtype=np.int32)], np.concatenate([[0], ends])[2 * offsets]


_encoders: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def marks(ids: np.ndarray, mask_bits: int = MASK_BITS) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids allows a cut."""
    gear = _GEAR[ids & 0xFF] ^ (_GEAR[(ids >> 8) & 0xFF] << np.uint64(1))
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(gear), ROLLED):
        before = max(0, at - WINDOW + 1)
        own = gear[before : at + ROLLED]
        rolled = own.copy()
        for k in range(1, WINDOW):
            rolled[k:] += own[:-k] << np.uint64(5 * k)
        out.append(np.flatnonzero((rolled[at - before :] >> np.uint64(64 - mask_bits)) == 0) + (at + 1))
    return np.concatenate(out)


def cuts(n: int, marked: list[int], min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of n ids with these marks. min_chunk is over WINDOW, so what stands before the ids has no say."""
    out, start = [], 0
    for m in [*marked, n]:
        while m - start > max_chunk:
            start += max_chunk
            out.append(start)
        if m - start >= min_chunk or (m == n and m > start):
            out.append(m)
            start = m
    return out


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    if not leaves:
        return digest(b"")
    level = leaves
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_PARTS = "kind int, doc_id long, n long, root binary, digests array<binary>, digest binary, payload binary"


def _encode(batches, tokenizer: str, end_id: int):
    """Recipes (kind 0) of all rows and, once a task, each chunk (kind 1)."""
    import public_tokenizers

    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("digest", pa.binary()), ("payload", pa.binary())])
    encoder = text_encoder(public_tokenizers.path(tokenizer))
    end = np.array([end_id], encoder.kind).tobytes()
    sent: set[bytes] = set()  # grows with the task's part of the input only
    for b in batches:
        ids_of, texts, at = b.column("doc_id"), b.column("text"), 0
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy())
        while at < b.num_rows:  # one text at least
            part = texts.slice(at, max(1, int(np.searchsorted(sizes, SLICE + (sizes[at - 1] if at else 0), "right")) - at))
            ids, edges = encoder(part)
            marked, data, width = marks(ids), ids.tobytes(), encoder.width
            within = np.searchsorted(marked, edges, "right").tolist()
            edges = edges.tolist()
            lengths, roots, recipes, chunks = [], [], [], {}
            for k in range(len(part)):
                start, stop = edges[k], edges[k + 1]
                n = stop - start + 1  # with the end id
                last, digests = 0, []
                for cut in cuts(n, (marked[within[k] : within[k + 1]] - start).tolist()):
                    payload = data[(start + last) * width : min(start + cut, stop) * width] + (end if cut == n else b"")
                    digests.append(key := digest(payload))
                    if key not in sent:
                        sent.add(key)
                        chunks[key] = payload
                    last = cut
                lengths.append(n)
                roots.append(merkle_root(digests))
                recipes.append(digests)
            rows, more = len(part), len(chunks)
            columns = [
                pa.array([0] * rows + [1] * more, pa.int32()), pa.concat_arrays([ids_of.slice(at, rows), pa.nulls(more, pa.int64())]), pa.array(lengths + [len(p) // width for p in chunks.values()], pa.int64()),
                pa.array(roots + [None] * more, pa.binary()), pa.array(recipes + [None] * more, pa.list_(pa.binary())), pa.array([None] * rows + list(chunks), pa.binary()), pa.array([None] * rows + list(chunks.values()), pa.binary()),
            ]
            at += rows
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, part_docs: int = PART_DOCS) -> None:
    """Writes docs (doc_id, text) as a store at path."""
    spark = docs.sparkSession
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _encode(b, tokenizer, end_id), _PARTS)
    # Recipes of equal roots are spread by id; a chunk comes from a task once, so no digest is hot.
    made = made.repartition(F.xxhash64("kind", "digest", "doc_id"))

    def once(batches):
        seen: set[bytes] = set()
        for b in batches:
            keys = b.column("digest").to_pylist()
            keep = [k is None or not (k in seen or seen.add(k)) for k in keys]
            yield b.filter(pa.array(keep))

    made.mapInArrow(once, _PARTS).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/loose")
    loose = _loose(spark, path, 0).select("doc_id", F.col("n").alias("n_tokens"), "root", "digests")
    n_parts = max(1, -(-loose.count() // part_docs))
    order = [F.col("doc_id").asc_nulls_first(), F.col("root")]
    ranged = loose.repartitionByRange(n_parts, *order, F.rand(7)).withColumn("part", F.spark_partition_id())  # equal rows are dealt out too
    ranged.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{path}/ordered")
    ordered = spark.read.parquet(f"{path}/ordered")
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each PART_DOCS documents
    total, starts = 0, []
    for r in parts:
        starts.append((r["part"], total))
        total += r["n"]
    in_part = Window.partitionBy("part").orderBy(*order)
    running = F.coalesce(F.sum("n_tokens").over(in_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    recipes = ordered.withColumns({"start": running, "pos": F.row_number().over(in_part) - 1}).join(small(spark, starts, "part int, base long"), "part").withColumn("start", F.col("start") + F.col("base"))
    recipes.select("part", "pos", "doc_id", "start", "n_tokens", "root", "digests").sortWithinPartitions("part", "pos").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _tree(spark, path).write.option("compression", "zstd").parquet(f"{path}/manifest")


_NODES = "level int, part int, pos int, n_docs long, n_tokens long, root binary"


def _tree(spark: SparkSession, path: str, fan: int = FAN) -> DataFrame:
    """The nodes of the Merkle tree over the recipes at path (see the module's text)."""

    def above(nodes: DataFrame, level: int, part) -> DataFrame:
        members = F.sort_array(F.collect_list(F.struct("part", "pos", "root")))  # fan at most
        grouped = nodes.groupBy(part.alias("part"), F.floor(F.col("pos") / fan).cast("int").alias("pos")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.transform(members, lambda m: m["root"]).alias("roots"))

        def run(batches):
            for b in batches:
                roots = pa.array([merkle_root(r) for r in b.column("roots").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([level] * b.num_rows, pa.int32()), *[b.column(c) for c in ("part", "pos", "n_docs", "n_tokens")], roots], names=["level", "part", "pos", "n_docs", "n_tokens", "root"])

        return written(grouped.mapInArrow(run, _NODES), "merkle")

    recipes = spark.read.parquet(f"{path}/recipes").select("part", "pos", "root", F.lit(1).cast("long").alias("n_docs"), "n_tokens")
    levels = [above(recipes, 0, F.col("part"))]
    while levels[-1].where("pos > 0").limit(1).count():  # up to one node for each part
        levels.append(above(levels[-1], len(levels), F.col("part")))
    roots = levels[-1].withColumns({"pos": F.col("part"), "part": F.lit(-1)})
    levels.append(above(roots, len(levels), F.col("part")))
    while levels[-1].where("pos > 0").limit(1).count():
        levels.append(above(levels[-1], len(levels), F.col("part")))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raises ValueError if the manifest at path isn't the tree over the recipes there."""
    keys, values = ["level", "part", "pos"], ["n_docs", "n_tokens", "root"]
    stored = spark.read.schema(_NODES).parquet(f"{path}/manifest").select(*keys, F.struct(*values).alias("stored"))
    built = _tree(spark, path).select(*keys, F.struct(*values).alias("built"))
    bad = stored.join(built, keys, "full_outer").where(~F.col("stored").eqNullSafe(F.col("built"))).orderBy(F.desc("level")).limit(1).collect()
    if bad:
        raise ValueError(f"the manifest differs from the recipes at level {bad[0]['level']}, part {bad[0]['part']}, node {bad[0]['pos']}")


def _loose(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema(_PARTS).parquet(f"{path}/loose").where(F.col("kind") == kind)  # reads one partition


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, payload of every stored chunk."""
    return _loose(spark, path, 1).select("digest", "n", "payload")


def _multiply(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reflected."""
    out, mask = 0, 1 << 31
    while a:
        if a & mask:
            out ^= b
            a ^= mask
        mask >>= 1
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


_shifts: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    if n_bytes not in _shifts:
        out, square, n = 1 << 31, 1 << 23, n_bytes
        while n:
            if n & 1:
                out = _multiply(square, out)
            square, n = _multiply(square, square), n >> 1
        _shifts[n_bytes] = out
    return _shifts[n_bytes]


def crc_of_parts(crcs: list[int], lengths: list[int]) -> int:
    """crc32 of a concatenation from its parts' crc32 and lengths in bytes."""
    out = 0
    for crc, n in zip(crcs, lengths):
        out = _multiply(_shift(n), out) ^ crc
    return out


def verified_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n, crc (of the ids as 32-bit integers) of each chunk; fails on a chunk that doesn't match its digest or length."""

    def run(batches):
        for b in batches:
            keys, n, crcs = b.column("digest").to_pylist(), b.column("n").to_pylist(), []
            for key, count, payload in zip(keys, n, b.column("payload").to_pylist()):
                if digest(payload) != key:
                    raise ValueError(f"chunk {key.hex()} does not match its digest")
                crcs.append(zlib.crc32(np.frombuffer(payload, f"<u{len(payload) // count}").astype("<u4")))
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])

    return chunks(spark, path).mapInArrow(run, "digest binary, n long, crc long")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, root (hex) of each document, verified from the manifest down to the chunks."""
    verify_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    distinct = recipes.groupBy("root").agg(F.first("digests").alias("digests"))
    slots = distinct.select("root", F.posexplode("digests").alias("pos", "digest"))
    joined = slots.join(verified_chunks(spark, path), "digest", "left").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n", "crc"))).alias("c"))

    def run(batches):
        for b in batches:
            roots, n, crcs = b.column("root").to_pylist(), [], []
            for root, c in zip(roots, b.column("c").to_pylist()):
                if any(x["n"] is None for x in c) or merkle_root([x["digest"] for x in c]) != root:
                    raise ValueError(f"document {root.hex()} can't be rebuilt from its chunks")
                n.append(sum(x["n"] for x in c))
                crcs.append(crc_of_parts([x["crc"] for x in c], [4 * x["n"] for x in c]))
            yield pa.RecordBatch.from_arrays([b.column("root"), pa.array(n, pa.int64()), pa.array(crcs, pa.int64())], names=["root", "built", "ids_crc32"])

    built = joined.mapInArrow(run, "root binary, built long, ids_crc32 long")
    out = recipes.withColumn("n_chunks", F.size("digests")).drop("digests").join(built, "root")
    checked = F.when(F.col("built") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's length differs from its chunks'")).cast("long"))
    return out.select("doc_id", "start", checked.alias("n_tokens"), "ids_crc32", "n_chunks", F.lower(F.hex("root")).alias("root"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>): the store's documents rebuilt."""
    slots = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    gathered = slots.join(chunks(spark, path), "digest").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "payload"))).alias("c"))

    def run(batches):
        for b in batches:
            ids = [np.concatenate([np.frombuffer(x["payload"], f"<u{len(x['payload']) // x['n']}").astype(np.int32) for x in c]) for c in b.column("c").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return gathered.mapInArrow(run, "doc_id long, start long, ids array<int>")


def op1_token_store(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
