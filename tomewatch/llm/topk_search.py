"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, a tree that merges top lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_tiles import Block, at_least_kth, entries, merged, per_tile, product, query_blocks, shards, side, tiles, whole_vectors


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of the highest score for every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    A score is the inner product of the vectors after floor(scale * x) of every component, exact as an integer; beyond a
    long it is held at the long's end. A query meets every row but itself. All rows are returned where there are fewer.

    Rows with a null id, a null vector or a component that is null or not finite take no part. Shorter vectors count as
    padded with zeros, so an empty one scores 0. Ties go to the smaller id. Of rows that repeat an id each is a query and a
    candidate of its own, so an id can be its own neighbour and be returned once for each of its rows. An empty table gives
    no rows; other columns, whatever their names, do not matter. Ids must be integers (TypeError).
    """
    table = shards(whole_vectors(df, id_col, vec_col, scale=scale))
    pairs, levels = tiles(query_blocks(table, every), table)

    def kernel(row: dict, _: dict) -> dict | None:
        q, s = Block(side(row, "q_")), Block(side(row, "s_"))
        scores = product(q.data, s.data, q.peak * s.peak)
        own = np.flatnonzero(q.origin[:, 0] == s.block)
        bottom = -np.inf if scores.dtype == float else np.iinfo(np.int64).min
        scores[own, q.origin[own, 1]] = bottom
        i, j = np.nonzero(at_least_kth(scores, k) & (scores > bottom))
        return {"q": i.astype(np.int32), "query": q.ids[i], "id": s.ids[j], "score": scores[i, j].astype(np.int64)}

    found = entries(merged(per_tile(pairs, ["query"], kernel), ["query"], k, levels), ["query"])
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
