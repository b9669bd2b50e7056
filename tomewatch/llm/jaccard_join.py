"""Exact n-gram Jaccard self-join as a blocked sparse product of documents and shingles.

The incidence matrix has a row per distinct shingle set and a column per shingle. A first product over a prefix of
each row tells which entries of the result can be large: in a global order from rare to frequent columns, two sets
of the wanted similarity share a column among the first ``n - ceil(t n) + 1`` of each. Entries that sizes, positions
or sketches rule out are discarded. For the others the product is taken in blocks of columns, whose overlap
counts are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, id_filter, integer_ids, may_hold, stored
from .kernels import SKETCH_CELLS, U, chunks, count_sketch, distinct_sorted, mix, shingles, trimmed

#: Longs of a set's parity sketch: bit k tells whether the elements hashed to k are odd in number.
PARITY = 8
_BITS = [f"x{k}" for k in range(PARITY)]
#: Columns of a block, on average: sets of more than this are multiplied in 2, 4, 8, ... blocks.
BLOCK = 1 << 13


def fingerprints(h: np.ndarray, begin: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit number of each set ``h[begin[k]:begin[k + 1]]``, whatever its order."""
    total = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(salt)), dtype=U)])
    return total[begin[1:]] - total[begin[:-1]]


def _rows(df: DataFrame, n: int, counts, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, size n, a 128-bit fingerprint of the set, its parity sketch and its prefix."""

    def run(batches):
        order = counts.value
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(1)):
                h, row = distinct_sorted(*shingles(data, offsets, n)[:2])
                size = np.bincount(row, minlength=hi - lo)
                begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                marks = [fingerprints(h, begin, salt) for salt in (0, 0x1234567)]
                scrambled = mix(h ^ U(0x5851F42D4C957F2D))
                word, bit = (scrambled >> U(6)) % U(PARITY), U(1) << (scrambled & U(63))
                parity = np.zeros((PARITY, hi - lo), U)
                np.bitwise_xor.at(parity, (word.astype(np.int64), row), bit)
                ranked = np.lexsort((h, order[(h % U(SKETCH_CELLS)).astype(np.int64)], row))
                keep = np.arange(len(h)) - begin[row] < (size - -(-num * size // den) + 1)[row]
                taken = np.bincount(row[keep], minlength=hi - lo)
                prefix = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(taken)]), pa.int32()), pa.array(h[ranked][keep].view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), *[pa.array(m.view(np.int64)) for m in (*marks, *parity)], prefix],
                    ["id", "n", "f1", "f2", *_BITS, "prefix"],
                )

    ids = df.select(integer_ids(df, id_col).alias("id"), F.col(text_col).cast("string"))
    return ids.mapInArrow(trimmed(run), f"id long, n long, f1 long, f2 long, {', '.join(f'{x} long' for x in _BITS)}, prefix array<long>")


def level(n: int, block: int = BLOCK) -> int:
    """The product of sets of up to n columns is taken in ``2 ** level(n)`` blocks."""
    return ((n - 1) // block).bit_length()


def _level(n: Column, block: int = BLOCK) -> Column:
    over = F.floor((n - 1) / block).cast("long")
    return F.when(over < 1, 0).otherwise(F.length(F.bin(over)))


def _blocks(df: DataFrame, n: int, num: int, den: int, block: int, bitmap, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint, level, block, sorted shingle hashes as bytes) of the documents whose id may be in ``bitmap``.

    Block k of 2 ** level holds the hashes whose leading bits are k. A set appears at its own level and, if a
    larger set that it may link with is taken in more blocks, at that set's.
    """

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(may_hold(bitmap.value, ids))
            if not len(mine):
                continue
            take = b.take(pa.array(mine))
            for lo, hi, data, offsets in chunks(take.column(1)):
                h, row = distinct_sorted(*shingles(data, offsets, n)[:2])
                size = np.bincount(row, minlength=hi - lo)
                begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                marks = fingerprints(h, begin).view(np.int64)
                owner, levels, numbers, starts, ends = [], [], [], [], []
                for r in range(hi - lo):
                    most = int(size[r]) * den // max(num, 1)
                    for deep in range(level(int(size[r]), block), level(most, block) + 1) if size[r] else ():
                        edges = np.searchsorted(h[begin[r] : begin[r + 1]], np.arange(1, 1 << deep, dtype=np.uint64) << U(64 - deep)) if deep else []
                        cut = [0, *edges, int(size[r])]
                        for k in range(1 << deep):
                            if cut[k + 1] > cut[k]:
                                owner.append(r), levels.append(deep), numbers.append(k)
                                starts.append(int(begin[r]) + cut[k]), ends.append(int(begin[r]) + cut[k + 1])
                view = memoryview(h).cast("B")
                held = pa.array([view[8 * s : 8 * e] for s, e in zip(starts, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [take.column(0).slice(lo, hi - lo).take(pa.array(owner, pa.int64())), pa.array(marks[owner]), pa.array(levels, pa.int32()), pa.array(numbers, pa.int64()), held],
                    ["id", "f", "level", "block", "h"],
                )

    ids = df.where(F.col(id_col).isNotNull()).select(integer_ids(df, id_col).alias("id"), F.col(text_col).cast("string"))
    return ids.mapInArrow(trimmed(run), "id long, f long, level int, block long, h binary")


def _product(pairs: DataFrame, df: DataFrame, n: int, num: int, den: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of sets of the fingerprints fa, fb and sizes na, nb whose overlap, added up over all blocks, reaches the similarity."""
    spark = df.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bitmap = spark.sparkContext.broadcast(id_filter(ids, "id"))
    blocks = _blocks(df, n, num, den, block, bitmap, id_col, text_col)

    def run(batches):
        for b in batches:
            x, y = b.column(7), b.column(8)
            common = np.zeros(len(b), np.int64)
            for k in range(len(b)):
                both = np.sort(np.concatenate([np.frombuffer(x[k].as_buffer(), U), np.frombuffer(y[k].as_buffer(), U)]), kind="stable")
                common[k] = (both[1:] == both[:-1]).sum()
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(common)], [*entry, "block", "common"])

    entry = ["a", "b", "fa", "fb", "na", "nb"]
    left, right = (blocks.select(F.col("id").alias(k), F.col("f").alias(f"f{k}"), "level", "block", F.col("h").alias(f"h{k}")) for k in "ab")
    paired = pairs.withColumn("level", _level(F.greatest("na", "nb"), block)).join(left, ["a", "fa", "level"]).join(right, ["b", "fb", "level", "block"])
    counted = paired.select(*entry, "block", "ha", "hb").mapInArrow(trimmed(run), ", ".join(f"{c} long" for c in (*entry, "block", "common")))
    # rows that repeat an id and a text give a block's count more than once
    total = counted.groupBy(*entry, "block").agg(F.max("common").alias("common")).groupBy(*entry).agg(F.sum("common").alias("common"))
    return total.where(F.col("common") * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def _close(a: str, b: str, num: int, den: int) -> Column:
    """Sketch bound: each element that only one set has turns one bit, so more differing bits than a link allows rule it out."""
    apart = sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in _BITS), F.lit(0))
    return apart * (num + den) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (den - num)


def _can_link(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Size-derived bound: with the first common column at these positions, can the overlap still suffice?"""
    most = F.least(n1 - p1, n2 - p2)
    return most * (num + den) >= (n1 + n2) * num


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, block: int = BLOCK
) -> DataFrame:
    """Components of the graph that links two documents when ``den * |A & B| >= num * |A | B|``.

    A and B are the sets of distinct word n-grams, words being runs of bytes other than ASCII white space
    with A-Z lower-cased. A text of fewer than n words has its whole sequence as one shingle; a text without
    words (null, empty) has an empty set and links with nothing. Returns (id, n_shingles, component_id), one
    row per row of ``docs``; component_id is the smallest id reachable by links. Ids must be integers.

    Steps, each over all documents:

    1. Count all shingles into a sketch of a fixed size. It only sets the order of the columns, so its
       collisions cost time and never a link; columns much more frequent than a cell's average stand out at any size.
    2. Equal sets become one row of the matrix, named by the smallest id, with a parity sketch of 512 bits.
    3. Prefixes are grouped by shingle. In a group, the row whose prefix reaches the shingle first is the
       pivot; every other row makes a pair with it only. Pairs that sizes, positions or sketches rule out are
       discarded; the product over blocks of columns decides over the rest. Links make components.
    4. In groups that still hold more than one component, rows outside the pivot's component are compared by size,
       position and sketch with the group's rows of other components, inside the join, so what cannot link makes no
       pair. The product decides over what is left. That completes the join: a pair left out is either in one
       component already or ruled out by an exact bound.

    A passage shared by many documents comes last in their order and so in no prefix; a large group of near
    copies costs one pair per member and shared prefix column with its pivot. Texts of a few common passages and nothing
    else do share prefixes; step 4 then makes comparisons, not pairs, with the square of a group. Group statistics are
    pre-aggregated and joined, so Spark can split a hot shingle over tasks. Shingle hashes have 64 bits, made from
    word hashes that the structure of a word cannot defeat.

    Rows of one id count as one document whose links are the union of the rows' links. A row with a null id
    is returned with its size and the component of its equal set, if any, but links nothing. An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    multiply = lambda pairs: _product(pairs, docs, n, num, den, block, id_col, text_col)
    order = spark.sparkContext.broadcast(count_sketch(docs, lambda d, o: shingles(d, o, n)[0], text_col))
    rows = checkpointed(_rows(docs, n, order, num, den, id_col, text_col))
    sets = (
        rows.where("n > 0 and id is not null")
        .groupBy("f1", "f2", "n")
        .agg(F.min("id").alias("node"), F.first("prefix").alias("prefix"), *[F.first(x).alias(x) for x in _BITS])
    )
    posts = sets.select("node", "n", F.posexplode("prefix").alias("p", "s"))
    marks = sets.select("node", "n", F.col("f1").alias("f"), *_BITS)
    of = lambda side: marks.select(*[F.col(c).alias(f"{side}_{c}") for c in marks.columns])

    # entries of the product with pivots
    first = F.struct((F.col("p") / F.col("n")).alias("at"), "node", "n", "p")
    shared = posts.groupBy("s").agg(F.count("*").alias("c"), F.min(first).alias("pivot")).where("c > 1").drop("c")
    grouped = stored(posts.join(shared, "s").select("s", "node", "n", "p", F.struct("pivot.node", "pivot.n", "pivot.p").alias("pivot")))
    bound = lambda a, b: _can_link(F.col(f"{a}n"), F.col(f"{a}p"), F.col(f"{b}n"), F.col(f"{b}p"), num, den)
    pairs = (
        grouped.where("node <> pivot.node")
        .where(bound("", "pivot."))
        .select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
        .distinct()
        .join(of("a"), F.col("a") == F.col("a_node"))
        .join(of("b"), F.col("b") == F.col("b_node"))
        .where(_close("a_", "b_", num, den))
        .select("a", "b", F.col("a_f").alias("fa"), F.col("b_f").alias("fb"), F.col("a_n").alias("na"), F.col("b_n").alias("nb"))
    )
    pairs = checkpointed(pairs)
    links = checkpointed(multiply(pairs))
    linked = components(links)

    # entries that the pivots did not join
    held = grouped.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = linked.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    held = held.join(heads, F.col("pivot.node") == F.col("head"), "left").withColumn("head_root", F.coalesce("head_root", "pivot.node"))
    held = held.where("node <> pivot.node").select("s", "node", "n", "p", "root", (F.col("root") == F.col("head_root")).alias("main"))
    held = checkpointed(held)
    # a group of one row besides its pivot has no further pair
    open_groups = held.groupBy("s").agg(F.count("*").alias("c"), F.bool_and("main").alias("done")).where("c > 1 and not done").select("s")
    held = held.join(open_groups, "s").join(marks, ["node", "n"])
    held = checkpointed(held)
    outside = held.where("not main").select("s", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "f", "p", "root", *_BITS)])
    swap = lambda c, o: (F.when(F.col("node") < F.col("o_node"), c).otherwise(o), F.when(F.col("node") < F.col("o_node"), o).otherwise(c))
    (fa, fb), (na, nb) = swap(F.col("f"), F.col("o_f")), swap(F.col("n"), F.col("o_n"))
    more = (
        held.join(outside, "s")
        .where("root <> o_root and (main or node < o_node)")
        .where(bound("", "o_"))
        .where(_close("", "o_", num, den))
        .select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"), fa.alias("fa"), fb.alias("fb"), na.alias("na"), nb.alias("nb"))
        .distinct()
    )
    more = checkpointed(more)
    if not more.isEmpty():
        links = links.union(multiply(more))
        linked = components(links)

    named = sets.select("f1", "f2", "n", "node").join(linked, "node", "left")
    named = named.select("f1", "f2", "n", F.coalesce("root", "node").alias("component"))
    empty = rows.where("n = 0").select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    full = rows.where("n > 0").join(named, ["f1", "f2", "n"], "left")
    full = full.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return full.union(empty).withColumnRenamed("id", id_col)
