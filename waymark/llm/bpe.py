"""Byte-level BPE with numpy matrices, and its inverse.

The pre-tokens of a batch that weren't met before are put in length buckets; each bucket is a padded
matrix of token ids. In every round each row finds, by a hashed look-up of its neighbouring pairs, the
pair of least rank, merges its leftmost occurrence, and is compacted by one column; rows without a
mergeable pair leave the matrix. A pre-token that is itself a token is that token. Ranks are those of
the tiktoken file; ids decode by joining their bytes.

Texts are cut at single blanks (see pieces.py) so that a worker meets frequent words once; what it
remembers is bounded. Pre-tokens of _LONG bytes and more are merged one by one with a heap, by the same
rule and look-up, as matrix rounds would take the square of their length.

Defined cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded
alike; very long texts and very long runs without white space are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from waymark.llm.common import table
from waymark.llm.pieces import PieceCache, chunks_of

RANKS = "byte_bpe_multi_50k.tiktoken"
_MAX_CELLS = 1 << 19
_NONE = 1 << 30
#: Bytes from which a pre-token is merged alone.
_LONG = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairs:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.width = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = {i: t for t, i in ranks.items()}
        self.decimal = {i: b"%d" % i for i in ranks.values()}
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() if len(t) > 1 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 3
        self._hash(left * self.width + right, merged.astype(np.int32))
        self.cache = PieceCache(self._make)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, filled in rounds."""
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.slot_keys = np.full(1 << self.bits, -1, np.int64)
        self.slot_values = np.full(1 << self.bits, _NONE, np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.slot_keys[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slot_keys[at[first]], self.slot_values[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], at[rest]
            at = np.where(self.slot_keys[at] >= 0, (at + 1) & ((1 << self.bits) - 1), at)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token's rank for each pair, _NONE where there is none."""
        keys = left.astype(np.int64) * self.width + right
        flat = keys.ravel()
        at = self._slot(flat)
        out = np.full(len(flat), _NONE, np.int32)
        open_ = np.arange(len(flat))
        while len(open_):
            held = self.slot_keys[at]
            hit = held == flat[open_]
            out[open_[hit]] = self.slot_values[at[hit]]
            go = ~hit & (held >= 0)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(keys.shape)

    def merge(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of byte strings of equal length bucket."""
        longest = max(map(len, rows))
        lengths = np.array([len(r) for r in rows])
        ids = np.zeros((len(rows), longest), np.int32)
        inside = np.arange(longest) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full((len(rows), max(longest - 1, 0)), _NONE, np.int32)
        pair = inside[:, 1:]
        rank[pair] = self.pair_ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        out: list = [None] * len(rows)
        alive = np.arange(len(rows))
        while len(alive):
            best = rank.min(axis=1) if rank.shape[1] else np.full(len(alive), _NONE)
            done = best == _NONE
            for k in np.nonzero(done)[0]:
                out[alive[k]] = ids[k, : lengths[k]].copy()
            if done.any():
                go = ~done
                alive, ids, rank, lengths, best = alive[go], ids[go], rank[go], lengths[go], best[go]
                if not len(alive):
                    break
                keep = lengths.max()
                ids, rank = ids[:, :keep], rank[:, : keep - 1]
            at = (rank == best[:, None]).argmax(axis=1)  # the leftmost
            r = np.arange(len(alive))
            # Compaction: columns right of the merged pair move left by one.
            cols = np.arange(ids.shape[1] - 1)
            ids[:, :-1] = np.where(cols > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[r, at] = best
            if rank.shape[1] > 1:
                rank[:, :-1] = np.where(cols[:-1] > at[:, None], rank[:, 1:], rank[:, :-1])
            lengths = lengths - 1
            rank[r, np.minimum(lengths - 1, rank.shape[1] - 1)] = np.where(lengths - 1 < rank.shape[1], _NONE, rank[r, -1])
            has = at + 1 < lengths
            k = r[has]
            rank[k, at[has]] = self.pair_ranks(ids[k, at[has]], ids[k, at[has] + 1])
            has = at > 0
            k = r[has]
            rank[k, at[has] - 1] = self.pair_ranks(ids[k, at[has] - 1], ids[k, at[has]])
        return out

    def encode_tokens(self, tokens: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        out: list = [None] * len(tokens)
        buckets: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            if (own := self.ranks.get(t)) is not None:
                out[i] = np.array([own], np.int32)
            elif len(t) >= _LONG:
                out[i] = self.merge_long(t)
            else:
                buckets.setdefault((len(t) - 1).bit_length() if len(t) > 16 else len(t) // 4 - 8, []).append(i)
        for members in buckets.values():
            members.sort(key=lambda i: len(tokens[i]))
            while members:
                n = max(1, _MAX_CELLS // len(tokens[members[min(len(members) - 1, 4095)]]))
                part, members = members[:n], members[n:]
                for i, ids in zip(part, self.merge([tokens[i] for i in part])):
                    out[i] = ids
        return out

    def merge_long(self, token: bytes) -> np.ndarray:
        """The same merges for one long pre-token, with a heap over a linked list: rounds of a matrix would take the square of its length."""
        ids = self.byte_ids[np.frombuffer(token, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        ids, last = ids.tolist(), len(ids) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        rank = [*first.tolist(), _NONE]
        heap = [(r, i) for i, r in enumerate(rank) if r != _NONE]
        heapq.heapify(heap)

        def ranked(i):
            n = after[i]
            rank[i] = self._pair(ids[i], ids[n]) if n <= last else _NONE
            if rank[i] != _NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            gone = after[i]
            ids[i], rank[gone], after[i] = r, -1, after[gone]
            if after[i] <= last:
                before[after[i]] = i
            ranked(i)
            if before[i] >= 0:
                ranked(before[i])
        return np.array([t for t, r in zip(ids, rank) if r != -1], np.int32)

    def _pair(self, left: int, right: int) -> int:
        return self.ranks.get(self.token_bytes[left] + self.token_bytes[right], _NONE)

    def _make(self, new: list[str]) -> list[bytes]:
        """The ids of each piece as int32 bytes."""
        # A blank and letters are one pre-token; the pattern decides the rest.
        split = [[p] if p[:1] == " " and p[1:].isalpha() else self.pattern.findall(p) for p in new]
        distinct = list({t for parts in split for t in parts})
        ids = dict(zip(distinct, (x.tobytes() for x in self.encode_tokens([t.encode("utf-8", "surrogatepass") for t in distinct]))))
        return [b"".join([ids[t] for t in parts]) for parts in split]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (None: none) as int32."""
        return [np.frombuffer(b"".join(values), np.int32) for values in self.cache(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_encoders: dict = {}


def encoder(path: str, pattern: str) -> BytePairs:
    """One for each worker process and file."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BytePairs(read_ranks(path), pattern)
    return _encoders[path, pattern]


def encoded(docs: DataFrame, ranks_name: str = RANKS, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array of int) if asked for.

    ranks_name: a file of the public tokenizers, found on each executor.
    """

    def run(batches):
        import public_tokenizers

        own = encoder(public_tokenizers.path(ranks_name), public_tokenizers.PATTERN)
        for b in batches:
            texts, n, ids_sha, bytes_sha, kept = b.column("text").to_pylist(), [], [], [], []
            for part in chunks_of(texts):
                for ids in own.encode(part):
                    listed = ids.tolist()
                    n.append(len(listed))
                    ids_sha.append(hashlib.sha256(b",".join(map(own.decimal.__getitem__, listed))).hexdigest())
                    bytes_sha.append(hashlib.sha256(own.decode(listed)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
