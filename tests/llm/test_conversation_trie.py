"""The trie against a brute-force one: long conversations over many segments, groups of copies over many shards, odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tomewatch.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key int, words string"


def brute(rows, group=20, heads=4):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    for x in turns.values():
        x.sort()
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        path = tuple(t[3:] for t in turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path)))
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    first = {p: min(c for c, _ in m) for p, m in members.items()}
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(c for c, n in m if n == len(p))).encode()).hexdigest() for p, m in members.items()}
    return sorted((first[p], len(p), first[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def some(n, seed, words=("a", "b c", "")):
    g = random.Random(seed)
    return [(c, k, g.choice(["user", "bot"]), g.choice(words)) for c in range(n) for k in range(g.randint(0, 6))]


def chains(lengths, texts):
    return [(c, k, "user", texts[k % len(texts)] + str(k)) for c, n in lengths.items() for k in range(n)]


ODD = [
    (1, 3, "user", "late"), (1, None, None, None), (1, 1, "user", "x  y　z"), (1, 1, "bot", "x  y　z"), (1, 1, "user", "x  y　z"), (None, 1, "user", "lost"), (2, 0, "a", "bc"), (3, 0, "ab", "c"),
    (20, 0, "u", "head one"), (21, 5, "u", "own"), (22, -4, "u", "own"), (22, 2000, "u", "far"), (22, 900, "u", "near"), (-3, 1, "u", "own"), (-20, 1, "u", "below"), (-25, None, "u", "long " * 20_000), (2**60, 0, "", ""),
]
LONG = chains({0: 100, 5: 100, 7: 99, 9: 40, 40: 32, 41: 32, 42: 33, 43: 64, 44: 65, 45: 31, 60: 7}, ["p q", "r", "s t u"]) + [(45, 40 + k, "user", "tail") for k in range(30)] + [(7, 200, "user", "end")]
CASES = {"small": some(60, 1), "copies": some(40, 2, ("same",)) + chains({k: 4 for k in range(100, 400)}, ["copy of it"]), "long": LONG, "mixed": some(150, 3) + chains({k: 35 for k in range(200, 240)}, ["w"]), "odd": ODD, "one": [(7, 0, "u", "t")], "none": []}


#: Segments of three turns, shards of five rows and many range partitions, so that nodes reach over all edges.
SMALL = ct.Sizes(segment=3, part_rows=11, shard_rows=5, slice=4)


@pytest.mark.parametrize("sizes", [SMALL, ct.Sizes()], ids=["small shards", "usual shards"])
@pytest.mark.parametrize("name", CASES)
def test_trie(spark, name, sizes):
    rows = spark.createDataFrame([(*r, "x", 1, "y") for r in CASES[name]], SCHEMA)
    got = ct.conversation_trie(rows, sizes=sizes)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(CASES[name]), key=repr)


def test_shuffled_joins(spark, monkeypatch):
    """The same where no lookup is small enough to be broadcast."""
    monkeypatch.setattr(ct, "BROADCAST_ROWS", 0)
    got = ct.conversation_trie(spark.createDataFrame([(*r, "x", 1, "y") for r in LONG], SCHEMA), sizes=ct.Sizes(segment=4))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(LONG), key=repr)


def test_integers_only(spark):
    with pytest.raises(TypeError):
        ct.conversation_trie(spark.createDataFrame([(1, 1, "a", "b", "x", 1, "y")], SCHEMA).withColumn("turn", F.col("turn").cast("string")))
