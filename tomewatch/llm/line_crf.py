"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, chunks, distinct_sorted, span_hashes, words

#: Labelled documents that the field is fitted on, those of the smallest id hash.
TRAIN_DOCS = 6_000
#: Lines of a chain while fitting; a longer document gives several chains, each line being in one of them.
CHAIN = 400
#: A good document's lines are good for at least this part of its bytes, a bad one's for at most this part.
GOOD, BAD = 0.9, 0.15
_CLASS = np.full(256, 3, np.uint8)  # 0 upper, 1 lower or beyond ASCII, 2 digit, 3 other, 4 space
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 0, 1, 1, 2
_CLASS[[9, 11, 12, 13, 32]] = 4
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
OWN = 12


@dataclass
class LineField:
    """Weights of the features of a line and its neighbours, the log-odds potentials of a transition, and the scaling."""

    weights: np.ndarray
    same: float
    mean: np.ndarray
    spread: np.ndarray


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, row) of every line of a chunk; lines end at line feeds and rows, blank lines are left out."""
    if not len(data):
        return np.zeros((0, OWN), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    feed = np.flatnonzero(data == 10)
    begin = np.union1d(offsets[:-1][np.diff(offsets) > 0], feed + 1)
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    end = end - (data[end - 1] == 10)
    kinds = _CLASS[data]
    count = []
    for k in range(5):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        count.append(total[end] - total[begin])
    used = np.flatnonzero((end - begin) - count[4] > 0)
    begin, end, count = begin[used], end[used], [c[used] for c in count]
    row = np.searchsorted(offsets, begin, "right") - 1
    size = (end - begin).astype(np.float64)
    starts, ends, _ = words(data, offsets)
    h = span_hashes(LOWER[data], starts, ends)
    line = np.searchsorted(begin, starts, "right") - 1
    n = len(begin)
    number = np.maximum(np.bincount(line, minlength=n), 1).astype(np.float64)
    again = np.append(False, (h[1:] == h[:-1]) & (line[1:] == line[:-1]))
    kept = distinct_sorted(h, line)[1]
    marked = _CLASS[data[np.maximum(ends - 2, 0)]] == 3
    marked &= (_CLASS[data[ends - 1]] == 3) & (ends - starts >= 2)
    same = span_hashes(data, begin, end)
    _, first, copies = np.unique(np.stack([same, row.astype(np.uint64)]), axis=1, return_inverse=True, return_counts=True)
    stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int64)])
    features = np.stack(
        [
            np.log1p(size) / 5,
            count[0] / size,
            count[2] / size,
            count[3] / size,
            count[4] / size,
            np.bincount(line, weights=(ends - starts), minlength=n) / number / 10,
            np.bincount(line, weights=again, minlength=n) / number,
            np.bincount(kept, minlength=n) / number,
            np.bincount(line, weights=marked, minlength=n) / number,
            copies[first.ravel()] > 1,
            (stops[end] - stops[begin]) / number,
            np.bincount(line, weights=(ends - starts == 1), minlength=n) / number,
        ],
        axis=1,
    )
    return features.astype(np.float32), size.astype(np.int64), row


def _with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its row, flags for missing ones, and a constant."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    joint = row[1:] == row[:-1] if n else np.zeros(0, bool)
    before[1:][joint] = x[:-1][joint]
    after[:-1][joint] = x[1:][joint]
    edges = np.zeros((n, 3))
    if n:
        edges[1:, 0], edges[:-1, 1], edges[:, 2] = joint, joint, 1
    return np.hstack([x, before, after, edges])


def _pass(a: np.ndarray, same: float) -> np.ndarray:
    """Log-odds of the next state from the log-odds of this one; ``same`` favours staying."""
    return np.logaddexp(same + a, 0) - np.logaddexp(a, same)


def messages(odds: np.ndarray, row: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """(forward, backward) log-odds of every line, its own odds being in forward. Rows are contiguous."""
    forward, backward = odds.copy(), np.zeros_like(odds)
    if not len(odds):
        return forward, backward
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(begin, len(row)))
    by = np.argsort(-size, kind="stable")
    begin, size = begin[by], size[by]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # rows with more than t lines
    for t in range(1, size[0]):
        at = begin[: live[t]] + t
        forward[at] += _pass(forward[at - 1], same)
    for t in range(size[0] - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        backward[at] = _pass(odds[at + 1] + backward[at + 1], same)
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def marginals(odds: np.ndarray, row: np.ndarray, same: float) -> np.ndarray:
    """Forward-backward: the probability that each line is good, given its row's log-odds."""
    forward, backward = messages(odds, row, same)
    return sigmoid(forward + backward)


def _totals(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=docs)


def tilted(odds: np.ndarray, row: np.ndarray, same: float, share: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log-odds whose marginals are nearest to the field's while every document's length-weighted one agrees with its label.

    Documents that agree keep their odds. Of others all lines move by one number a document, found by bisection.
    ``share`` is a line's part of its document's bytes.
    """
    level = lambda shift: _totals(share * marginals(odds + shift[doc], row, same), doc, len(labels))
    now = level(np.zeros(len(labels)))
    wanted = np.where(labels == 1, np.maximum(now, GOOD), np.minimum(now, BAD))
    low, high = np.where(wanted < now, -40.0, 0.0), np.where(wanted > now, 40.0, 0.0)
    for _ in range(16):
        middle = (low + high) / 2
        above = level(middle) > wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return odds + np.where(wanted == now, 0.0, (low + high) / 2)[doc]


def _stay(forward: np.ndarray, odds: np.ndarray, backward: np.ndarray, same: float, i: np.ndarray) -> np.ndarray:
    """Probability that lines i and i + 1 are alike, from the pairwise marginals."""
    into, out = forward[i], odds[i + 1] + backward[i + 1]
    return sigmoid(np.logaddexp(same + into + out, same) - np.logaddexp(into, out))


def fit(features: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, rounds: int = 4, steps: int = 80, penalty: float = 2e-3) -> LineField:
    """Fit the field with the lines' labels latent: only a document's length-weighted share of good lines is known.

    Round 0 takes every line to be like its document. Later rounds take the field's own marginals, moved no more than the
    documents' labels ask (posterior regularisation), so lines of one document may differ. Each round maximises the
    expected conditional likelihood by Adam.
    """
    doc = np.repeat(np.arange(len(features)), [len(f) for f in features])
    within = np.concatenate([np.arange(len(f)) for f in features])
    row = np.cumsum(np.append(0, (doc[1:] != doc[:-1]) | (within[1:] % CHAIN == 0)))
    raw = np.concatenate(features).astype(np.float64)
    mean, spread = raw.mean(0), raw.std(0) + 1e-3
    x = _with_neighbours((raw - mean) / spread, doc)
    size = np.concatenate(sizes).astype(np.float64)
    share = size / _totals(size, doc, len(labels))[doc]
    weigh = 1 / np.bincount(doc)[doc]  # each document counts once
    i = np.flatnonzero(np.append(row[1:] == row[:-1], False))
    line, alike = labels[doc].astype(np.float64), np.ones(len(i))
    theta, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, rounds * steps + 1):
        w, same = theta[:-1], theta[-1]
        odds = x @ w
        if step > 1 and step % steps == 1:
            moved = tilted(odds, row, same, share, doc, labels)
            forward, backward = messages(moved, row, same)
            line, alike = sigmoid(forward + backward), _stay(forward, moved, backward, same, i)
        forward, backward = messages(odds, row, same)
        grad = x.T @ (weigh * (line - sigmoid(forward + backward))) / len(labels)
        grad_same = float((weigh[i] * (alike - _stay(forward, odds, backward, same, i))).sum()) / len(labels)
        g = np.append(grad, grad_same) - penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return LineField(theta[:-1], float(theta[-1]), mean, spread)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_docs: int = TRAIN_DOCS,
) -> LineField | None:
    """Fit the field on at most ``train_docs`` labelled documents; None if there is no labelled text.

    The sample is the labelled ids of the smallest hash, so it is the same on every run. Features are made on
    the executors from whole texts; the driver gets 52 bytes a line, of one row an id however often ids repeat (that
    of the largest features).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sample = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(train_docs)

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(1)):
                x, size, row = line_features(data, offsets)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                held = [np.hstack([x[s:e], size[s:e, None].astype(np.float32)]).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(held, pa.binary())], ["k", "y", "x"])

    chosen = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(F.xxhash64(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), "y")
    once = chosen.mapInArrow(run, "k long, y int, x binary").groupBy("k", "y").agg(F.max("x").alias("x"))
    got = sorted((r for r in once.collect() if len(r["x"])), key=lambda r: r["k"])
    if not got:
        return None
    lines = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, OWN + 1) for r in got]
    return fit([x[:, :OWN] for x in lines], [x[:, OWN] for x in lines], np.array([r["y"] for r in got]))


def score_lines(field: LineField, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of good, bytes, row) of every line of a chunk."""
    x, size, row = line_features(data, offsets)
    odds = _with_neighbours((x - field.mean) / field.spread, row) @ field.weights
    return marginals(odds, row, field.same), size, row


def score_documents(docs: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_lines, n_bad_lines) for every row: the lines' marginals averaged by their bytes.

    A line is bad if its marginal is below one half. A text without a non-blank line (null, empty) has score 0
    and no lines; without a fitted field every other text scores 0.5. A map over rows, no shuffle; the field is
    a few hundred numbers. Null ids pass through, repeated rows score alike, other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for b in batches:
            out = []
            for lo, hi, data, offsets in chunks(b.column(1)):
                if held.value is None:
                    _, size, row = line_features(data, offsets)
                    p = np.full(len(row), 0.5)
                else:
                    p, size, row = score_lines(held.value, data, offsets)
                total = np.bincount(row, weights=size, minlength=hi - lo)
                good = np.bincount(row, weights=size * p, minlength=hi - lo)
                score = np.clip(np.divide(good, total, out=np.zeros(hi - lo), where=total > 0), 0, 1)
                out.append((score, np.bincount(row, minlength=hi - lo), np.bincount(row, weights=p < 0.5, minlength=hi - lo).astype(np.int64)))
            if out:
                cols = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "score", "n_lines", "n_bad_lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double, n_lines long, n_bad_lines long")
