import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from waymark.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, digest string, depth string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])
        rebuilt[c] = tuple(base[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(r[:-1] == q for r in members if len(r) == len(q) + 1)]
        saved = sum((len(members[q]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))
        kids = sum(1 for q in members if len(q) == len(p) + 1 and q[: len(p)] == p)
        parent = min(members[p[:-1]]) if p else None
        out.add((min(cs), len(p), parent, len(cs), kids, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, rows, block=prefix_trie.BLOCK):
    turns = spark.createDataFrame([(*r, "clash", None) for r in rows], KIND).repartition(3)
    found = prefix_trie.trie(turns, block).drop("digest", "parent").collect()
    assert len(set(found)) == len(found)
    return {tuple(r) for r in found}


def some(seed, convs, most):
    rng = random.Random(seed)
    return [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "a b c", None, "", " x\t", "a b"])) for c in convs for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("block", [2, 3, 32])
def test_matches_brute_force(spark, block):
    rows = some(block, [*range(0, 50), *range(-25, -18), 1009, 10**15], 9)
    assert nodes(spark, rows, block) == brute(rows)


def test_copies_deep_and_odd_conversations(spark):
    chat = [("user", "hi there"), ("assistant", "x" * 200_000), ("user", None)]
    rows = [(c, i, r, t) for c in range(0, 400, 20) for i, (r, t) in enumerate(chat)]  # copies
    rows += [(1000, i, "user", f"w {i % 2}") for i in range(70)] + [(1020, i, "user", f"w {i % 2}") for i in range(60)]  # deep
    rows += [(1041, 0, "user", "only")] + [(None, 0, "user", "nobody's")] + [(1060, None, None, None)] * 2 + [(1060, 0, "user", "a"), (1060, 0, "user", "a")]
    assert nodes(spark, rows, 4) == nodes(spark, rows) == brute(rows)


def test_no_turns(spark):
    assert nodes(spark, []) == set()
    assert nodes(spark, [(None, 1, "user", "a")]) == set()


def test_pieces_of_ids_join_to_one_hash(spark):
    ids = [(k, i) for k in (b"a", b"b") for i in range(-3, 500, 3)]
    df = spark.createDataFrame(ids, "key binary, id long").repartition(5)
    found = {bytes(r.key): r.sha256 for r in prefix_trie.joined_hashes(df, piece=20).collect()}
    want = hashlib.sha256(",".join(str(i) for i in range(-3, 500, 3)).encode()).hexdigest()
    assert found == {b"a": want, b"b": want}
    assert prefix_trie.joined_hashes(df.where(F.lit(False))).count() == 0
