"""Exact search and hard negatives against brute force: ties, repeats, odd rows, wide and very large vectors, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewatch.llm import vector_tiles
from tomewatch.llm.hard_negatives import SEGMENTS, bounds, mine, summary
from tomewatch.llm.topk_search import top_k

SCHEMA = "vec_id long, embedding array<double>, label int, score string, block int, q string"
LONGEST = 2**63 - 1


def usable(rows, labelled=False):
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and not (labelled and label is None):
            yield i, [math.floor(256 * x) for x in v], label


def dot(a, b):
    return max(-LONGEST, min(LONGEST, sum(x * y for x, y in zip(a, b, strict=False))))


def brute_top(rows, k, every):
    rows = list(usable(rows))
    out = []
    for a, (i, v, _) in enumerate(rows):
        if i % every == 0:
            found = sorted((-dot(v, w), j) for b, (j, w, _) in enumerate(rows) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def brute_mine(rows, every, n_positives=5, n_negatives=3, low=50, high=95):
    rows = list(usable(rows, labelled=True))
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i % every == 0:
            found = sorted((-dot(v, w), j, other) for b, (j, w, other) in enumerate(rows) if b != a)
            for ps, pid, _ in [f for f in found if f[2] == label][:n_positives]:
                band = [f for f in found if f[2] != label and low * -ps <= 100 * -f[0] <= high * -ps][:n_negatives]
                out += [(i, pid, r, f[1], -ps, -f[0]) for r, f in enumerate(band, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], SCHEMA)


def some(n, width, seed, step=1):
    """Vectors around few centres, every fifth a copy of another, labels in three classes of which one is common."""
    g = np.random.default_rng(seed)
    centres = g.normal(size=(4, width)) / 4
    rows = [(step * k, (centres[k % 4] + g.normal(size=width) / 6).tolist(), int(g.choice([0, 0, 0, 1, 2]))) for k in range(n)]
    return [(i, rows[i // step // 2][1], label) if k % 5 == 0 else (i, v, label) for k, (i, v, label) in enumerate(rows)]


ODD = [
    (100, None, 1), (105, [None, 1.0], 1), (110, [float("nan"), 1.0], 1), (115, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (120, [], 1), (125, [0.5], None), (130, [0.25, -0.5, 0.75], 1),
    (135, [0.1] * 70, 1), (140, [0.0] * 3, 2), (0, [0.3, 0.3], 1), (0, [0.3, 0.3], 1), (5, [0.3, 0.3], 2), (-5, [-0.3, 0.2], 2), (-7, [0.3, 0.2], 1),
]
HUGE = [(k, [(-1.0) ** k * 3e7 * (k + 1), 2e7, float(k)], k % 2) for k in range(12)] + [(50 + k, [1e12 * (k + 1), 1e15], k % 2) for k in range(6)] + [(70, [1e300, 1.0], 0), (75, [-1e300, 1e300], 1)]
CASES = {"near": some(300, 64, 1), "narrow": some(120, 3, 2, step=5), "wide": some(60, 200, 3), "odd": ODD, "huge": HUGE, "one": [(0, [0.5], 0)], "none": []}


@pytest.fixture(params=[True, False], ids=["small tiles", "usual tiles"])
def sizes(request, monkeypatch):
    """Tiles so small that a few rows make many cells, strips and levels of merging."""
    if request.param:
        monkeypatch.setattr(vector_tiles.shards, "__defaults__", (7,))
        monkeypatch.setattr(vector_tiles.query_blocks, "__defaults__", (3,))
        for name, value in (("CELL_QUERIES", 2), ("CELL_SHARDS", 3), ("FAN_IN", 2)):
            monkeypatch.setattr(vector_tiles, name, value)
    return 4 if request.param else 1024


@pytest.mark.parametrize("name", CASES)
def test_top_k(spark, sizes, name):
    got = top_k(table(spark, CASES[name]), k=4, every=5)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute_top(CASES[name], 4, 5)


@pytest.mark.parametrize("name", CASES)
def test_mine(spark, sizes, name):
    got = mine(table(spark, CASES[name]), every=5, strip=sizes)
    assert sorted(map(tuple, got.collect())) == brute_mine(CASES[name], 5)


def test_bounds_hold_and_tighten():
    a, b = (np.array([[math.floor(256 * x) for x in v] for _, v, _ in some(80, 64, s)], float) for s in (4, 5))
    score, widths = a @ b.T, []
    for size in SEGMENTS:
        lower, upper = bounds(summary(a, size), summary(b, size))
        assert (lower <= score).all() and (score <= upper).all()
        widths.append((upper - lower).mean())
    assert widths == sorted(widths, reverse=True)


def test_ids_must_be_integers(spark):
    for f in (top_k, mine):
        with pytest.raises(TypeError):
            f(table(spark, ODD).withColumn("vec_id", F.col("vec_id").cast("string")))
