"""Vectorised byte, word and shingle hashing over Arrow batches of whole texts.

A text column is handled as UTF-8 bytes in chunks of whole documents of about CHUNK bytes, so a worker's
memory depends on the chunk (or on one very long text), not on the batch or the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

CHUNK = 1 << 20
U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) of pieces of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number, zeros beyond the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))


#: Masks of the first 0 to 8 bytes of a number.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of ``data[i:i + k]`` for every i, eight bytes at a time; cheap, and not proof against made-up data."""
    n = len(data) - k + 1
    eights, h = _eights(data), np.full(n, k, U)
    for j, at in enumerate(range(0, k, 8)):
        part = eights[at : at + n]
        h += (part if k - at >= 8 else part & _FIRST_BYTES[k - at]) * _PLACES[j]
    h ^= h >> U(32)
    h *= U(0xFF51AFD7ED558CCD)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes give equal hashes wherever they stand.

    Up to sixteen bytes are scrambled as two numbers, longer spans are hashed one by one (XXH3), so no structure
    of long spans makes hashes agree.
    """
    eights, size = _eights(data), ends - starts
    h = mix(mix(eights[starts] & _FIRST_BYTES[np.minimum(size, 8)]) ^ size.astype(U) * U(0x632BE59BD9B4E019))
    more = np.flatnonzero(size > 8)
    h[more] = mix(h[more] ^ (eights[starts[more] + 8] & _FIRST_BYTES[np.minimum(size[more] - 8, 8)]))
    whole = np.flatnonzero(size > 16)
    view = memoryview(np.ascontiguousarray(data))
    h[whole] = np.fromiter((xxh3_64_intdigest(view[s:e]) for s, e in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True)), U, len(whole))
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of a chunk: runs of bytes outside SPACE that do not cross rows."""
    inside = ~SPACE[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word's index) of all word n-grams of a chunk, lower-cased in A-Z.

    A row of fewer than n words gives its whole sequence as one shingle, a row without words none.
    """
    lowered = LOWER[data]
    starts, ends, row = words(data, offsets)
    h = span_hashes(lowered, starts, ends)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    at = np.arange(len(h))
    full = at + n <= (begin + count)[row]
    at = at[full]
    total = np.zeros(len(at), U)
    for j in range(n):
        total += h[at + j] * _PLACES[j]
    out, out_row = [mix(total)], [row[at]]
    for m in range(1, min(n, 64)):
        short = begin[count == m]
        if len(short):
            total = np.full(len(short), m, U)
            for j in range(m):
                total += h[short + j] * _PLACES[j]
            out.append(mix(total ^ U(0x5851F42D4C957F2D)))
            out_row.append(np.flatnonzero(count == m))
            at = np.concatenate([at, short])
    return np.concatenate(out), np.concatenate(out_row), at


def distinct_sorted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, by row and then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when it ends, the worker, which Spark keeps for later tasks, gives freed memory back."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


SKETCH_CELLS = 1 << 20
_PIECES, _PARTS = 64, 64


def count_sketch(
    df: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], text_col: str, prepare: Callable[[pa.Array], pa.Array] = lambda texts: texts
) -> np.ndarray:
    """How often each of SKETCH_CELLS cells (hash mod cells) occurs over all rows of ``df``.

    Every task adds up its own cells and sends them once, in pieces that are summed as streams: first by piece
    and by one of _PARTS parts of the tasks, then by piece, so that however many tasks send, _PIECES * _PARTS keys
    share their sums. A task holds one sum at a time. The driver gets one table of a fixed size (8 MB). ``hashes`` maps a chunk of the
    prepared texts to the 64-bit hashes to count.
    """

    def row(piece: int, part: int, cells: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["piece", "part", "cells"])

    def tally(batches):
        cells = np.zeros(SKETCH_CELLS, np.int64)
        for b in batches:
            for _, _, data, offsets in chunks(prepare(b.column(0))):
                cells += np.bincount((hashes(data, offsets) % U(SKETCH_CELLS)).astype(np.int64), minlength=SKETCH_CELLS)
        part = TaskContext.get().partitionId() % _PARTS
        for k, p in enumerate(np.split(cells, _PIECES)):
            if p.any():
                yield row(k, part, p)

    def add(batches):
        now, total = None, None
        for b in batches:
            for k, part, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                counts = np.frombuffer(p.as_buffer(), np.int64)
                if (k, part) != now:
                    if now:
                        yield row(*now, total)
                    now, total = (k, part), counts
                else:
                    total = total + counts
        if now:
            yield row(*now, total)

    kind = "piece int, part int, cells binary"
    summed = lambda rows, *by: rows.repartition(*by).sortWithinPartitions("piece", "part").mapInArrow(trimmed(add), kind)
    sent = df.select(F.col(text_col).cast("string")).mapInArrow(trimmed(tally), kind)
    whole = summed(summed(sent, "piece", "part").withColumn("part", F.lit(0)), "piece")
    out = np.zeros((_PIECES, SKETCH_CELLS // _PIECES), np.int64)
    for r in whole.toLocalIterator():
        out[r["piece"]] += np.frombuffer(bytes(r["cells"]), np.int64)
    return out.reshape(-1)
