"""Jaccard components and repeated substrings against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomewatch.llm import jaccard_join, suffix_dedup
from tomewatch.llm.jaccard_join import jaccard_components
from tomewatch.llm.suffix_dedup import remove_repeats

SCHEMA = "text string, doc_id long, node string, id string"


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünder", "née"]
    rows = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 80]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(rng.choice([" ", "\n", "\t\x0b"]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    common = " ".join(f"c{k}" for k in range(30))
    rows += [f"{common} {k} {k} {k} {k} {' '.join(str(k * j) for j in range(k))}" for k in range(40)]
    rows += ["", None, "   ", "one", "one", "one two", "ONE TWO", " ".join("abcdefgh" * 4000), "a " * 3000]
    rng.shuffle(rows)
    return [(t, k * 3 + 1, "x", None) for k, t in enumerate(rows)]


def brute_components(rows, n, num, den):
    sets = {}
    for t, d, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (2, 50)])
def test_components(spark, n, num):
    rows = near_rows()
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(5), n=n, num=num, den=100).collect()
    want = brute_components(rows, n, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)


def test_components_of_words_made_to_collide(spark):
    for size in (512, 4096):
        w, v = thue_morse(size, "x", "y")
        rows = [(f"{w} b c d", 1, None, None), (f"{v} b c d", 2, None, None), (f"{w} b c d", 3, None, None)]
        got = jaccard_components(spark.createDataFrame(rows, SCHEMA), n=4, num=85).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_components_in_many_blocks(spark):
    """Sets taken in several blocks, at differing levels, give the counts of whole sets."""
    assert [jaccard_join.level(n, 16) for n in (1, 16, 17, 32, 33, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
    sizes = spark.createDataFrame([(n,) for n in range(1, 200)], "n long").select("n", jaccard_join._level(F.col("n"), 16).alias("l")).collect()
    assert all(r.l == jaccard_join.level(r.n, 16) for r in sizes)
    rows = near_rows()
    for n, num in ((4, 85), (2, 50)):
        got = jaccard_components(spark.createDataFrame(rows, SCHEMA), n=n, num=num, block=16).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, num, 100)


def templated(count):
    rng = random.Random(4)
    passages = [" ".join(f"p{k}x{j}" for j in range(20)) for k in range(40)]
    return [(" ".join(rng.sample(passages, 5)), k, None, None) for k in range(count)]


def test_pairs_of_templated_texts_grow_with_their_number(spark, monkeypatch):
    """Texts of common passages share prefixes by the square of their number, but nearly none of them makes a pair."""
    made = []
    product = jaccard_join._product
    monkeypatch.setattr(jaccard_join, "_product", lambda pairs, *a: made.append(pairs.count()) or product(pairs, *a))
    for count in (200, 400):
        rows = templated(count)
        made.clear()
        got = jaccard_components(spark.createDataFrame(rows, SCHEMA), n=4, num=85).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85, 100)
        assert sum(made) <= count // 4, made


def test_components_of_repeated_ids(spark):
    """Rows of one id are one document with the links of all its rows."""
    words = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(words[0], 5, None, None), (words[1], 5, None, None), (words[1], 5, None, None), (words[0] + " z", 9, None, None), (words[1] + " z", 7, None, None), (words[2], 8, None, None)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), n=4, num=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (5, 5), (7, 5), (8, 8), (9, 5)]


def test_components_edges(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a b c d e f", None, None, None), ("a b c d e f", 7, None, None), (None, None, None, None), ("a b c d e f", 7, None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("7", 2, 7), ("7", 2, 7), ("None", 0, None), ("None", 2, 7)]


def brute_repeats(rows, length):
    seen, out = set(), {}
    for t, d, *_ in sorted(rows, key=lambda r: r[1]):
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passage, other = text(300), text(130)
    rows = [text(rng.choice([0, 30, 120, 400])) for _ in range(30)]
    rows += [text(rng.randrange(60)) + rng.choice([passage, other, passage[40:260], passage[::-1]]) + text(rng.randrange(60)) for _ in range(60)]
    rows += [passage] * 5 + ["ab" * 400, "a" * 900, "a" * 99, "a" * 100, None, "", passage + passage, other * 3 + passage]
    rng.shuffle(rows)
    return [(t, k * 2, "x", "y") for k, t in enumerate(rows)]


@pytest.mark.parametrize("limit", [20_000, 3])
def test_repeats(spark, limit):
    rows = repeat_rows()
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), frequent=limit).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got}
    assert found == brute_repeats(rows, 100) and len(got) == len(rows)


def thue_morse(n, a="a", b="b"):
    """A word of n letters and its complement; polynomial hashes modulo a power of two cannot tell them apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join((a, b)[k] for k in bits), "".join((b, a)[k] for k in bits)


@pytest.mark.parametrize("limit", [20_000, 3])
def test_repeats_of_words_made_to_collide(spark, limit):
    w, v = thue_morse(4096)
    rows = [("x" * 40 + w[:2048] + v[:2048], 1, None, None), ("x" * 40 + v + "x" * 40, 2, None, None), (w, 3, None, None)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA), frequent=limit).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == brute_repeats(rows, 100)


def test_repeats_in_pieces(spark, monkeypatch):
    """Rows longer than a worker's piece are read in overlapping parts, with the same result."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdé ") for _ in range(700))
    rows = [("".join(rng.choice("xyz ") for _ in range(900)) + passage, 1, None, None), (passage * 3 + "q" * 1000, 2, None, None), (passage[50:], 0, None, None)]
    texts = pa.array([r[0] for r in rows])
    whole = [suffix_dedup._anchor_hashes(100, 16)(d, o) for _, _, d, o in suffix_dedup.chunks(texts, 1)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    cut = [suffix_dedup._anchor_hashes(100, 16)(d, o) for _, _, d, o in suffix_dedup.chunks(texts, 1)]
    assert [set(a) for a in whole] == [set(a) for a in cut] and sum(map(len, cut)) > sum(map(len, whole))
    starts = [(base, len(d)) for base, d, _ in suffix_dedup._pieces(np.zeros(1000, np.uint8), np.array([0, 1000]), 100)]
    assert starts == [(0, 355), (256, 355), (512, 355), (768, 232)]


def test_repeats_ids(spark):
    with pytest.raises(TypeError, match="integer"):
        remove_repeats(spark.createDataFrame([("a", "b")], "text string, doc_id string"))


def test_repeats_edges(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    got = remove_repeats(spark.createDataFrame([("a" * 300, None, None, None)], SCHEMA)).collect()
    assert [(r.n_bytes, r.n_removed) for r in got] == [(300, 0)]
