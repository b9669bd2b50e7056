"""Blocks of whole-numbered vectors, tiles of query blocks against shards, and trees that merge top lists.

A vector table becomes a stored table of shards: one row holds up to SHARD_ROWS vectors as a matrix. Queries are packed
the same way. A grid of cells deals query blocks and shards so that every pair of them meets in one cell, as a tile; a
cell holds a bounded number of both. Nothing is collected to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_ids, stored

#: Rows of a shard and of a query block; a matrix of wide vectors is cut earlier, at MATRIX_BYTES as doubles.
SHARD_ROWS, QUERY_ROWS, MATRIX_BYTES = 4096, 512, 8 << 20
#: Query blocks and shards that a cell of the grid holds at most, and the fan-in of a merge.
CELL_QUERIES, CELL_SHARDS, FAN_IN = 64, 32, 16
LONGEST = 2**63 - 1

BLOCK = "block long, n int, width int, ids binary, labels binary, origin binary, data binary, kind string"


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None, scale: float = 256.0) -> DataFrame:
    """(id, label, vec) of the rows that take part: floor(scale * x) of every component x as a double.

    Rows with a null id, a null vector, or any component that is null, not finite, or not finite once scaled, are left
    out; with ``label_col`` so are those with a null label. Other columns do not matter, whatever their names.
    """
    label = integer_ids(df, label_col) if label_col else F.lit(0).cast("long")
    rows = df.select(integer_ids(df, id_col).alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and label is not null and vec is not null")
    fit = F.forall("vec", lambda x: F.coalesce(F.abs(x * scale) < float("inf"), F.lit(False)))
    return rows.where(fit).withColumn("vec", F.transform("vec", lambda x: x * scale))


def narrow(m: np.ndarray) -> tuple[bytes, str]:
    """A matrix of whole numbers in the smallest of three types that holds it."""
    top = np.abs(m).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return m.astype(kind).tobytes(), kind


class Block:
    """A packed row: ids, labels, where each vector came from (shard, position), and the matrix."""

    def __init__(self, row: dict):
        self.block, self.n, self.width = row["block"], row["n"], row["width"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.origin = np.frombuffer(row["origin"], "<i8").reshape(-1, 2)
        self.data = np.frombuffer(row["data"], row["kind"]).reshape(self.n, self.width).astype(float)
        self.peak = np.abs(self.data).max(initial=0)


def packed_row(block: int, ids: np.ndarray, labels: np.ndarray, origin: np.ndarray, m: np.ndarray) -> dict:
    data, kind = narrow(m)
    return {"block": block, "n": len(ids), "width": m.shape[1], "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "origin": origin.astype("<i8").tobytes(), "data": data, "kind": kind}


def columns_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


BLOCK_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "origin", "data")], ("kind", pa.string())])


def rows_for(width: int, most: int) -> int:
    return max(1, min(most, MATRIX_BYTES // (8 * max(1, width))))


def shards(rows: DataFrame, most: int = SHARD_ROWS) -> DataFrame:
    """``whole_vectors`` packed where they lie, without a shuffle, and stored; ids ascend within a shard.

    Shorter vectors are padded with zeros to the widest of their shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, np.ndarray]] = []
        width = 0

        def cut() -> pa.RecordBatch:
            nonlocal number, held, width
            held.sort(key=lambda r: r[0])
            m = np.zeros((len(held), width))
            for k, (_, _, v) in enumerate(held):
                m[k, : len(v)] = v
            place = np.column_stack([np.full(len(held), number), np.arange(len(held))])
            row = packed_row(number, np.array([r[0] for r in held]), np.array([r[1] for r in held]), place, np.floor(m))
            number, held, width = number + 1, [], 0
            return columns_of([row], BLOCK_ARROW)

        for b in batches:
            lists = b.column("vec")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for k, (i, label) in enumerate(zip(b.column("id").to_pylist(), b.column("label").to_pylist(), strict=True)):
                v = flat[at[k] : at[k + 1]]
                if held and len(held) >= rows_for(max(width, len(v)), most):
                    yield cut()
                held.append((i, label, v))
                width = max(width, len(v))
        if held:
            yield cut()

    return stored(rows.mapInArrow(run, BLOCK))


def query_blocks(table: DataFrame, every: int, most: int = QUERY_ROWS) -> DataFrame:
    """The vectors of ``shards`` whose id is divisible by ``every``, packed anew and stored; each keeps its origin."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Block(row)
                at = np.flatnonzero(s.ids % every == 0)
                if len(at):
                    yield columns_of([packed_row(s.block, s.ids[at], s.labels[at], s.origin[at], s.data[at])], BLOCK_ARROW)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[Block] = []

        def cut(parts: list[Block]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            width = max(p.width for p in parts)
            m = np.concatenate([np.pad(p.data, ((0, 0), (0, width - p.width))) for p in parts])
            ids, labels, origin = (np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "labels", "origin"))
            step = rows_for(width, most)
            for k in range(0, len(ids), step):
                yield columns_of([packed_row(number, ids[k : k + step], labels[k : k + step], origin[k : k + step], m[k : k + step])], BLOCK_ARROW)
                number += 1

        for b in batches:
            for row in b.to_pylist():
                held.append(Block(row))
                if sum(p.n for p in held) >= rows_for(max(p.width for p in held), most):
                    yield from cut(held)
                    held = []
        if held:
            yield from cut(held)

    few = stored(table.mapInArrow(pick, BLOCK))
    total = few.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return stored(few.repartition(max(1, -(-total // most)), "block").mapInArrow(join, BLOCK))


def tiles(queries: DataFrame, table: DataFrame) -> tuple[DataFrame, int]:
    """Every query block beside every shard, one row a tile with its ``node`` (a leaf of the merge tree), and the tree's levels.

    ``queries`` may bring more columns. Cell (r, c) of the grid gets the query blocks of row r and the shards of column c,
    so a query block is sent once per column and a shard once per row; cells are joined by key, as blocks.
    """
    n_q, n_s = queries.count(), table.count()
    spread = 2 * queries.sparkSession.sparkContext.defaultParallelism
    rows, cols = max(1, -(-n_q // CELL_QUERIES)), max(1, min(n_s, max(-(-n_s // CELL_SHARDS), spread)))
    levels = 1
    while FAN_IN**levels < n_s:
        levels += 1
    pick = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("long")
    cell = lambda r, c: (r * cols + c).cast("long")
    q = queries.withColumn("r", pick(rows)).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    s = table.withColumn("c", pick(cols)).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    s = s.select(cell(F.col("r"), F.col("c")).alias("cell"), pick(FAN_IN**levels).alias("node"), *[F.col(c).alias(f"s_{c}") for c in table.columns])
    q = q.select(cell(F.col("r"), F.col("c")).alias("cell"), *[F.col(c).alias(f"q_{c}") for c in queries.columns])
    parts = min(rows * cols, 100_000)
    return q.repartition(parts, "cell").join(s.repartition(parts, "cell"), "cell").drop("cell"), levels


def side(row: dict, mark: str) -> dict:
    return {k[2:]: v for k, v in row.items() if k.startswith(mark)}


def product(a: np.ndarray, b: np.ndarray, peaks: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as float64 or, past 2**53, int64 held within a long.

    ``peaks`` is the product of the largest magnitudes. Sums below 2**24 are exact in single, below 2**53 in double
    precision, in whatever order they are added; others are added as Python integers and held at the ends of a long.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * peaks < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(float)
    if width * peaks < 2**53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    exact = whole(a) @ whole(b).T if width else np.zeros((len(a), len(b)), dtype=object)
    return np.array([[max(-LONGEST, min(LONGEST, x)) for x in r] for r in exact], dtype=np.int64).reshape(len(a), len(b))


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the ``k`` highest scores of their row, ties to smaller ids; in order of row, then rank."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return order[rank < k]


def at_least_kth(scores: np.ndarray, k: int) -> np.ndarray:
    """A mask of a dense tile: in each row the k highest scores, ties to the first columns."""
    n = scores.shape[1]
    if n <= k:
        return np.ones(scores.shape, bool)
    kth = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, equal = scores > kth, scores == kth
    return above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))


def lists_schema(payload: list[str]) -> tuple[str, pa.Schema]:
    """The packed top lists of one query block: entry's query row ``q``, the ``payload`` columns, then id and score."""
    ddl = ", ".join(["qb long", "node long", "q array<int>", *[f"{p} array<long>" for p in (*payload, "id", "score")]])
    return ddl, pa.schema([("qb", pa.int64()), ("node", pa.int64()), ("q", pa.list_(pa.int32())), *[(p, pa.list_(pa.int64())) for p in (*payload, "id", "score")]])


def per_tile(pairs: DataFrame, payload: list[str], kernel: Callable[[dict, dict], dict | None]) -> DataFrame:
    """``kernel`` on every tile: it gets the row and a dict that lasts for the task, and gives the entries of the tile's lists."""
    ddl, arrow = lists_schema(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                found = kernel(row, kept)
                if found is not None and len(found["q"]):
                    yield columns_of([{"qb": row["q_block"], "node": row["node"]} | found], arrow)

    return pairs.mapInArrow(run, ddl)


def merged(lists: DataFrame, payload: list[str], k: int, levels: int) -> DataFrame:
    """One row a query block with the ``k`` best entries of each query, merged FAN_IN lists at a time, level by level."""
    ddl, arrow = lists_schema(payload)
    names = ["q", *payload, "id", "score"]

    def merge(t: pa.Table) -> pa.Table:
        flat = {c: np.concatenate([x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in t.column(c).chunks]) for c in names}
        keep = best(flat["q"], flat["id"], flat["score"], k)
        row = {"qb": t.column("qb")[0].as_py(), "node": t.column("node")[0].as_py()} | {c: v[keep] for c, v in flat.items()}
        return pa.Table.from_pylist([row], schema=arrow)

    for _ in range(levels):
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("qb", "node").applyInArrow(merge, ddl)
    return lists


def entries(lists: DataFrame, payload: list[str]) -> DataFrame:
    """Packed top lists as rows: q, the payload, id, score, and the rank within the query, from 1."""
    zipped = F.arrays_zip("q", *payload, "id", "score")
    ranked = F.transform(zipped, lambda e, i: F.struct(e["q"].alias("q"), *[e[p].alias(p) for p in (*payload, "id", "score")], (i - F.array_position("q", e["q"]) + 2).cast("int").alias("rank")))
    return lists.select(F.inline(ranked))
