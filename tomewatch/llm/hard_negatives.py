"""Hard negatives: bounds from segment means and deviations rule pairs out, level by level, before exact scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vector_tiles import LONGEST, Block, best, entries, merged, per_tile, product, query_blocks, shards, side, tiles, whole_vectors

#: Components in a segment, from coarse to fine; every level splits each segment of the one before.
SEGMENTS = (64, 16, 4)
#: Columns of a shard that are judged at a time, so that what is found raises the floor for the rest.
STRIP = 1024


def summary(m: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every segment of ``size`` components, each times the root of the size."""
    parts = np.pad(m, ((0, 0), (0, -m.shape[1] % size))).reshape(len(m), -1, size)
    mean = parts.mean(2)
    return mean * size**0.5, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products: means' product minus and plus deviations' product, with room for rounding."""
    n = min(a[0].shape[1], b[0].shape[1])
    mid, off = a[0][:, :n] @ b[0][:, :n].T, a[1][:, :n] @ b[1][:, :n].T
    off += 1e-9 * (np.abs(mid) + off) + 1e-6
    sure = np.isfinite(mid) & np.isfinite(off)
    return np.where(sure, mid - off, -np.inf), np.where(sure, mid + off, np.inf)


def exact(q: np.ndarray, s: np.ndarray, alive: np.ndarray, peaks: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs in ``alive``: the whole product where many are left, else those pairs alone."""
    i, j = np.nonzero(alive)
    width = min(q.shape[1], s.shape[1])
    if len(i) * 8 > alive.size or width * peaks >= 2**53:
        return i, j, product(q, s, peaks)[i, j].astype(np.int64)
    return i, j, np.einsum("ij,ij->i", q[i, :width], s[j, :width]).astype(np.int64)


def bands(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest whole number that are at least ``low`` and at most ``high`` per cent of each score."""
    part = lambda p, up: np.array([(-((-p * int(x)) // 100) if up else p * int(x) // 100) for x in score], dtype=object)
    clip = lambda v: np.array([max(-LONGEST, min(LONGEST, x)) for x in v], dtype=np.int64)
    return clip(part(low, True)), clip(part(high, False))


def strips(q: Block, s: Block, kept: dict, allow: np.ndarray, floor: np.ndarray, ceiling: np.ndarray | None, size: int):
    """Per strip of the shard: the survivors (i, j, score) of all levels. ``floor`` is read anew for each strip."""
    peaks = q.peak * s.peak
    levels = kept.setdefault(("summary", q.block), [summary(q.data, x) for x in SEGMENTS])
    own = [summary(s.data, x) for x in SEGMENTS]
    for at in range(0, s.n, size):
        cut = slice(at, at + size)
        alive = allow[:, cut].copy()
        for mine, theirs in zip(levels, own, strict=True):
            if not alive.any():
                break
            lower, upper = bounds(mine, tuple(x[cut] for x in theirs))
            alive &= upper >= floor[:, None]
            if ceiling is not None:
                alive &= lower <= ceiling[:, None]
        i, j, score = exact(q.data, s.data[cut], alive, peaks)
        yield i, j + at, score


def mine(df: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0, strip: int = STRIP) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its ``n_positives`` other rows of
    the same label with the highest scores (integer inner products after floor(scale * x)). For each positive come the
    ``n_negatives`` highest rows of another label that score at least ``low`` and at most ``high`` per cent of the positive.
    Ties go to the smaller id. Segment means and deviations bound every score from both sides (Cauchy-Schwarz); pairs that
    no bound can save are dropped at 64, then 16, then 4 components a segment, and only the rest is scored.

    Rows with a null id, label or vector or a component that is null or not finite take no part. Shorter vectors count as
    padded with zeros. Of rows that repeat an id each is an anchor and a candidate of its own. Anchors without positives,
    positives of a negative score, and positives without a row in their band give nothing. An empty table gives no rows;
    other columns do not matter. Ids and labels must be integers (TypeError).
    """
    table = shards(whole_vectors(df, id_col, vec_col, label_col, scale))
    anchors = query_blocks(table, every)

    def positives(row: dict, kept: dict) -> dict | None:
        q, s = Block(side(row, "q_")), Block(side(row, "s_"))
        top = kept.setdefault(q.block, np.full((q.n, n_positives), -np.inf))
        allow = q.labels[:, None] == s.labels[None, :]
        own = np.flatnonzero(q.origin[:, 0] == s.block)
        allow[own, q.origin[own, 1]] = False
        found, floor = [], top[:, -1].copy()
        for i, j, score in strips(q, s, kept, allow, floor, None, strip):
            take = best(i, s.ids[j], score, n_positives)
            i, j, score = i[take], j[take], score[take]
            found.append((i, j, score))
            raised(top, i, score)
            floor[:] = top[:, -1]
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        take = best(i, s.ids[j], score, n_positives)
        return {"q": i[take].astype(np.int32), "id": s.ids[j[take]], "score": score[take]}

    pairs, levels = tiles(anchors, table)
    first = merged(per_tile(pairs, [], positives), [], n_positives, levels)
    first = first.select(F.col("qb").alias("block"), F.col("q").alias("pq"), F.col("id").alias("pid"), F.col("score").alias("pscore"))
    with_positives = stored(anchors.join(first, "block"))
    payload = ["anchor", "positive", "positive_score"]

    def negatives(row: dict, kept: dict) -> dict | None:
        q, s = Block(side(row, "q_")), Block(side(row, "s_"))
        pq, pid, pscore = (np.array(row[f"q_{c}"], dtype=np.int64) for c in ("pq", "pid", "pscore"))
        lo, hi = bands(pscore, low, high)
        use = np.flatnonzero(lo <= hi)
        if not len(use):
            return None
        top = kept.setdefault(q.block, np.full((len(pq), n_negatives), -np.inf))
        floor, ceiling = np.full(q.n, np.inf), np.full(q.n, -np.inf)

        def reset() -> None:
            floor[:] = np.inf
            np.minimum.at(floor, pq[use], np.maximum(lo[use], top[use, -1]))

        reset()
        np.maximum.at(ceiling, pq[use], hi[use])
        allow = q.labels[:, None] != s.labels[None, :]
        found = []
        starts = np.searchsorted(pq, np.arange(q.n + 1))  # lists come in order of their query row
        for i, j, score in strips(q, s, kept, allow, floor, ceiling, strip):
            for k in range(n_positives):
                p = starts[i] + k
                there = np.flatnonzero(p < starts[i + 1])
                p = p[there]
                fits = (lo[p] <= score[there]) & (score[there] <= hi[p]) & (score[there] >= top[p, -1])
                p, at = p[fits], there[fits]
                take = best(p, s.ids[j[at]], score[at], n_negatives)
                p, at = p[take], at[take]
                found.append((p, j[at], score[at]))
                raised(top, p, score[at])
            reset()
        p, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        take = best(p, s.ids[j], score, n_negatives)
        p, j, score = p[take], j[take], score[take]
        return {"q": p.astype(np.int32), "anchor": q.ids[pq[p]], "positive": pid[p], "positive_score": pscore[p], "id": s.ids[j], "score": score}

    pairs, levels = tiles(with_positives, table)
    found = entries(merged(per_tile(pairs, payload, negatives), payload, n_negatives, levels), payload)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def raised(top: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
    """Take entries (grouped by row, best first, at most as many a row as ``top`` is wide) into the rows' best scores."""
    if not len(rows):
        return
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    new = np.full(top.shape, -np.inf)
    new[rows, rank] = scores
    both = np.concatenate([top, new], axis=1)
    top[:] = -np.sort(-both, axis=1)[:, : top.shape[1]]
