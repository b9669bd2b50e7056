"""Prefix trie of conversations from padded matrices of turn ids, sorted shard by shard.

A turn's id is the 128-bit digest of its role and text. A conversation is cut into segments of some turns; a segment's
row holds its ids and the ``class`` of all turns before it (a 120-bit digest), so no row grows with its conversation. Range
partitions of these rows by (segment number, class, ids) are sorted by numpy's lexsort. Where a column or one before it
differs from the row above (change masks, OR-accumulated), a node starts; ``reduceat`` sums every depth between starts.
Each shard knows the rows beside it, so the partial sums of nodes that reach over a shard's edge just add up.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_bounded, integer_ids, stored


@dataclass(frozen=True)
class Sizes:
    """Turns of a segment; rows of a range partition (sorted in memory) and of a shard; turn numbers of a slice."""

    segment: int = 32
    part_rows: int = 65_536
    shard_rows: int = 8_192
    slice: int = 1_024


#: Rows up to which a lookup is broadcast.
BROADCAST_ROWS = 500_000
NO_TURN = -(2**62)


def ranked_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(conv, rank from 1, key, words): the turns of each conversation in order, null turns first, stored.

    Equal turn numbers come in order of their keys. A conversation is numbered in slices of turn numbers, so a very
    long one is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    turn = integer_ids(df, turn_col)
    turns = df.select(integer_ids(df, conv_col).alias("conv"), turn.alias("turn"), key.alias("key"), words.alias("words")).where("conv is not null")
    turns = turns.withColumn("slice", F.coalesce(F.floor(F.col("turn") / sizes.slice), F.lit(NO_TURN)))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offset = turns.groupBy("conv", "slice").agg(F.count("*").alias("n")).select("conv", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "slice").orderBy(F.asc_nulls_first("turn"), "key"))
    return stored(turns.join(offset, ["conv", "slice"]).select("conv", (F.col("before") + place).alias("rank"), "key", "words"))


def branched(ranked: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv, depth, key, words) of rebuilt conversations, with a row of depth 0 for each, even a turnless one.

    Conversation c begins with the first h turns of conversation c - c % group (all if it has fewer, none if there is no
    such one), h = crc32(c as text) % heads, and goes on with its own turns after its first h.
    """
    base = lambda c: c - c % group
    h = F.crc32(F.col("conv").cast("string")) % heads
    convs = ranked.select("conv").distinct().select("conv", base(F.col("conv")).alias("base"), h.alias("h"))
    first = ranked.where((F.col("conv") % group == 0) & (F.col("rank") < heads)).select(F.col("conv").alias("base"), "rank", "key", "words")
    head = convs.join(first, "base").where(F.col("rank") <= F.col("h")).select("conv", F.col("rank").alias("depth"), "key", "words")
    held = first.groupBy("base").agg(F.count("*").alias("held"))
    own = ranked.withColumn("h", h).where(F.col("rank") > F.col("h")).withColumn("base", base(F.col("conv"))).join(held, "base", "left")
    own = own.select("conv", (F.col("rank") - F.col("h") + F.least("h", F.coalesce("held", F.lit(0)))).alias("depth"), "key", "words")
    return head.unionByName(own).unionByName(convs.select("conv", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("")).alias("key"), F.lit(0).cast("long").alias("words")))


def class_halves(b: Column, path: Column) -> list[Column]:
    """Two 60-bit numbers of a segment; the exclusive-or of those of all earlier segments is a row's class."""
    digest = F.md5(F.concat(F.encode(F.concat(b.cast("string"), F.lit(":")), "UTF-8"), path))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """(conv, b, c1, c2, path, cont, words) from (conv, depth, key, words): one row a segment, stored; ``cont`` tells that more follow."""
    b = F.expr(f"greatest(depth - 1, 0) div {segment}")
    items = F.array_sort(F.collect_list(F.struct("depth", "key", "words")))
    rows = turns.groupBy("conv", b.alias("b")).agg(F.filter(items, lambda e: e["depth"] > 0).alias("items"))
    path = F.aggregate("items", F.unhex(F.lit("")), lambda acc, e: F.concat(acc, e["key"]))
    rows = stored(rows.select("conv", "b", path.alias("path"), F.transform("items", lambda e: e["words"]).alias("words")))
    full = (F.col("b") > 0) | (F.size("words") == segment)
    whole = Window.partitionBy("conv").orderBy("b")
    c = class_halves(F.col("b"), F.col("path"))
    earlier = [F.coalesce(F.bit_xor(x).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")) for x in c]
    long = rows.where(full).select("conv", "b", earlier[0].alias("c1"), earlier[1].alias("c2"), "path", F.lead("b").over(whole).isNotNull().alias("cont"), "words")
    zero = F.lit(0).cast("long")
    return rows.where(~full).select("conv", "b", zero.alias("c1"), zero.alias("c2"), "path", F.lit(False).alias("cont"), "words").union(long)


def edge(b: int, c1: int, c2: int, cont: bool, path: bytes) -> bytes:
    return struct.pack("<qqq?", b, c1, c2, cont) + path


class Shard:
    """Sorted rows of a packed shard with the rows above and below it; ``mask`` [row, j]: differs from the row above within j turns."""

    def __init__(self, row: dict, segment: int):
        self.segment = segment
        self.conv, self.b, self.c1, self.c2 = (np.frombuffer(row[c], "<i8") for c in ("conv", "b", "c1", "c2"))
        self.cont, self.len = np.frombuffer(row["cont"], "?"), np.frombuffer(row["len"], "<i4")
        n = len(self.conv)
        col = np.arange(segment)
        held = col < self.len[:, None]
        self.ids = np.zeros((n + 2, segment, 2), ">u8")
        self.ids[1:-1][held] = np.frombuffer(row["ids"], ">u8").reshape(-1, 2)
        self.words = np.zeros((n, segment), np.int64)
        self.words[held] = np.frombuffer(row["words"], "<i8")
        heads = np.zeros((n + 2, 3), np.int64)
        heads[1:-1] = np.column_stack([self.b, self.c1, self.c2])
        for at, near in ((0, row["above"]), (n + 1, row["below"])):
            heads[at] = (-1, 0, 0)
            if near:
                heads[at] = struct.unpack("<qqq", near[:24])
                found = np.frombuffer(near[25:], ">u8").reshape(-1, 2)
                self.ids[at, : len(found)] = found
        changed = np.empty((n + 1, segment + 1), bool)
        changed[:, 0] = (heads[1:] != heads[:-1]).any(1)
        changed[:, 1:] = (self.ids[1:] != self.ids[:-1]).any(2)
        mask = np.logical_or.accumulate(changed, axis=1)
        self.mask, self.next = mask[:-1], mask[1:]
        at_end = self.next[np.arange(n), self.len]
        self.leaf = (~self.cont & at_end).astype(np.int64)
        self.spared = np.where(held & ~self.mask[:, 1:], self.words, 0)

    def path(self, r: int, j: int) -> bytes:
        return self.ids[r + 1, :j].tobytes()

    def key(self, r: int, j: int) -> str:
        """What a node is called where its members lie in more than one shard; the end of a segment is called as the class after it."""
        b, c1, c2 = int(self.b[r]), int(self.c1[r]), int(self.c2[r])
        if 0 < j < self.segment:
            return f"{b * self.segment + j}|{hashlib.md5(edge(b, c1, c2, False, self.path(r, j))).hexdigest()}"
        if j:
            digest = hashlib.md5(f"{b}:".encode() + self.path(r, j)).hexdigest()
            c1, c2 = c1 ^ int(digest[:15], 16), c2 ^ int(digest[15:30], 16)
        return f"{b * self.segment + j}|{c1}|{c2}"


BLOBS = ("conv", "b", "c1", "c2", "cont", "len", "ids", "words")
SHARD_SCHEMA = "part long, strip int, " + ", ".join(f"{c} binary" for c in (*BLOBS, "above", "below", "head", "tail"))
SHARD_ARROW = pa.schema([("part", pa.int64()), ("strip", pa.int32()), *[(c, pa.binary()) for c in (*BLOBS, "above", "below", "head", "tail")]])


def sorted_shards(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """Range partitions of ``segments``, each sorted in memory and cut into shards, stored; every shard has the rows next to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), [x for x in batches if x.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        n = t.num_rows
        conv, b, c1, c2 = (t.column(c).to_numpy() for c in ("conv", "b", "c1", "c2"))
        cont = t.column("cont").to_numpy(zero_copy_only=False).astype(bool)
        paths, words = t.column("path").to_pylist(), t.column("words").to_pylist()
        length = np.array([len(w) for w in words], np.int32)
        ids = np.zeros((n, sizes.segment, 2), np.uint64)
        ids[np.arange(sizes.segment) < length[:, None]] = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
        width = int(length.max())
        order = np.lexsort((conv, cont, *[ids[:, j, k] for j in range(width - 1, -1, -1) for k in (1, 0)], c2, c1, b))
        near = lambda k: edge(int(b[r := order[k]]), int(c1[r]), int(c2[r]), bool(cont[r]), paths[r])
        for strip, at in enumerate(range(0, n, sizes.shard_rows)):
            o, end = order[at : at + sizes.shard_rows], min(n, at + sizes.shard_rows)
            blobs = {"conv": conv[o].astype("<i8"), "b": b[o].astype("<i8"), "c1": c1[o].astype("<i8"), "c2": c2[o].astype("<i8"), "cont": cont[o], "len": length[o].astype("<i4")}
            row = {k: v.tobytes() for k, v in blobs.items()} | {"ids": b"".join(paths[r] for r in o), "words": np.array([w for r in o for w in words[r]], "<i8").tobytes()}
            row |= {"part": part, "strip": strip, "above": near(at - 1) if at else None, "below": near(end) if end < n else None, "head": near(0) if not at else None, "tail": near(n - 1) if end == n else None}
            yield pa.RecordBatch.from_pylist([row], schema=SHARD_ARROW)

    rows = stored(rows)
    n = rows.count()
    parts = max(1, -(-n // sizes.part_rows), min(n // 256, 2 * rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.repartitionByRange(parts, "b", "c1", "c2", "path", "cont", "conv").mapInArrow(run, SHARD_SCHEMA)
    made = stored(dealt)
    edges = made.groupBy("part").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    line = Window.orderBy("part")  # one row a partition
    edges = edges.select("part", F.lag("tail").over(line).alias("_above"), F.lead("head").over(line).alias("_below"))
    both = made.join(broadcast_if_bounded(edges, BROADCAST_ROWS // 10), "part")
    above = F.when(F.col("head").isNotNull(), F.col("_above")).otherwise(F.col("above"))
    below = F.when(F.col("tail").isNotNull(), F.col("_below")).otherwise(F.col("below"))
    return both.select("part", "strip", *BLOBS, above.alias("above"), below.alias("below"))


def with_deeper(shards: DataFrame, segment: int) -> DataFrame:
    """Shards with ``deeper``: for rows whose conversation goes on, what its later segments spare and whether it ends in a leaf of its own."""

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row, segment)
                for at, wanted in ((s.b - 1, s.b > 0), (s.b, s.cont)):
                    r = np.flatnonzero(wanted)
                    here = at is s.b
                    cols = [s.conv[r], at[r], *([np.full(len(r), x) for x in (row["part"], row["strip"])] if here else [np.full(len(r), -1)] * 2), r if here else r * 0 - 1, s.spared.sum(1)[r], s.leaf[r]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], ["conv", "b", "part", "strip", "pos", "spared", "leaf"])

    none = F.lit(None).cast("array<struct<pos: bigint, spared: bigint, leaf: bigint>>").alias("deeper")
    told = stored(shards.mapInArrow(later, "conv long, b long, part long, strip long, pos long, spared long, leaf long"))
    n = told.where("pos >= 0").count()
    if not n:
        return shards.select("*", none)
    after = Window.partitionBy("conv").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    sums = told.where("pos < 0").select("conv", "b", F.sum("spared").over(after).alias("spared"), F.max("leaf").over(after).alias("leaf"))
    each = told.where("pos >= 0").select("conv", "b", "part", "strip", "pos").join(sums, ["conv", "b"])
    lists = each.groupBy("part", F.col("strip").cast("int").alias("strip")).agg(F.collect_list(F.struct("pos", "spared", "leaf")).alias("deeper"))
    return shards.join(F.broadcast(lists) if n <= BROADCAST_ROWS else lists, ["part", "strip"], "left")


NODE = [("key", pa.string()), ("depth", pa.int64()), ("conv", pa.int64()), ("parent_key", pa.string()), ("parent_conv", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.list_(pa.int64()))]
NODE_SCHEMA = ", ".join(f"{c} {'string' if t == pa.string() else 'long' if t == pa.int64() else 'array<long>'}" for c, t in NODE)


def nodes_of(s: Shard, deeper: list[dict] | None) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard, a batch a depth: whole ones with their digest, parts of others under their key."""
    n = len(s.conv)
    leaf, rest = s.leaf.copy(), np.zeros(n, np.int64)
    for d in deeper or ():
        leaf[d["pos"]], rest[d["pos"]] = d["leaf"], d["spared"]
    saved = np.cumsum(s.spared[:, ::-1], axis=1)[:, ::-1] + rest[:, None]
    group, above_whole, above_conv = np.zeros(n, int), np.zeros(0, bool), np.zeros(0, np.int64)
    for j in range(int(s.len.max()) + 1):
        rows = np.flatnonzero(s.len >= j)
        starts = np.flatnonzero(s.mask[rows, j] | (rows == 0))
        first, last = rows[starts], rows[np.r_[starts[1:], len(rows)] - 1]
        total = lambda v: np.add.reduceat(np.asarray(v, np.int64), starts)  # noqa: E731, B023
        children = total((s.len[rows] > j) & s.mask[rows, j + 1]) if j < s.segment else np.zeros(len(starts), np.int64)
        conv = np.minimum.reduceat(s.conv[rows], starts)
        counts, leaves, spared = np.diff(np.r_[starts, len(rows)]), total(leaf[rows]), total(saved[rows, max(j, 1) - 1])
        again = (s.b[first] > 0) & (j == 0)  # the end of an earlier segment: only its children are here
        part = again | ((first == 0) & ~s.mask[first, j]) | ((last == n - 1) & ~s.next[last, j])
        if j == s.segment:
            part |= total(s.cont[rows]) > 0
        mine = np.cumsum(s.mask[rows, j] | (rows == 0)) - 1
        parent = group[first]
        group = np.full(n, -1)
        group[rows] = mine
        ends: dict[int, list[int]] = {}
        over = (s.len[rows] == j) & ~s.cont[rows] & ~again[mine]
        for r, g in zip(rows[over].tolist(), mine[over].tolist(), strict=True):
            ends.setdefault(g, []).append(int(s.conv[r]))
        told = j > 0
        by_key = [told and not above_whole[parent[k]] for k in range(len(starts))]
        yield pa.RecordBatch.from_pydict(
            {
                "key": [s.key(int(first[k]), j) if part[k] else None for k in range(len(starts))], "depth": s.b[first] * s.segment + j, "conv": [None if again[k] else int(conv[k]) for k in range(len(starts))],
                "parent_key": [s.key(int(first[k]), j - 1) if by_key[k] else None for k in range(len(starts))], "parent_conv": [int(above_conv[parent[k]]) if told and not by_key[k] else None for k in range(len(starts))],
                "n_convs": np.where(again, 0, counts), "n_children": children, "n_leaves": np.where(again, 0, leaves), "saved": np.where(again, 0, spared),
                "ends_sha256": [None if part[k] else hashlib.sha256(",".join(map(str, ends.get(k, ()))).encode()).hexdigest() for k in range(len(starts))], "ends": [ends.get(k) if part[k] else None for k in range(len(starts))],
            }, schema=pa.schema(NODE),
        )
        above_whole, above_conv = ~part, conv


def digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv): ids in ascending order, joined by commas, hashed as a stream that holds nothing but its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        out = lambda: pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})
        for b in batches:
            for k, conv in zip(b.column("key").to_pylist(), b.column("conv").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield out()
                    key, state = k, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
        if key is not None:
            yield out()

    return ends.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(run, "key string, ends_sha256 string")


def trie(turns: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """The nodes of the prefix trie of (conv, depth, key, words), one row of depth 0 for each conversation included.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from nodes_of(Shard(row, sizes.segment), row["deeper"])

    found = stored(with_deeper(sorted_shards(segments(turns, sizes.segment), sizes), sizes.segment).mapInArrow(run, NODE_SCHEMA))
    parts = found.where("key is not null")
    hashes = digests(parts.select("key", F.explode("ends").alias("conv")))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    joined = parts.groupBy("key", "depth").agg(F.min("conv").alias("conv"), F.max("parent_key").alias("parent_key"), F.max("parent_conv").alias("parent_conv"), *sums).join(hashes, "key", "left")
    joined = stored(joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))))
    columns = ["conv", "depth", "parent_key", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    whole = found.where("key is null").select(columns).union(joined.select(columns))
    names = broadcast_if_bounded(joined.select(F.col("key").alias("parent_key"), F.col("conv").alias("_parent")), BROADCAST_ROWS)
    named = whole.where("parent_key is not null").join(names, "parent_key").withColumn("parent_conv", F.col("_parent")).select(columns)
    out = named.union(whole.where("parent_key is null"))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def conversation_trie(df: DataFrame, group: int = 20, heads: int = 4, sizes: Sizes = Sizes(), **columns: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations of ``df`` (conv_id, turn, role, text; other names by ``*_col``).

    Turns are ordered by turn, null first, equal ones by the digest of role and text; null role or text counts as empty,
    repeated rows are turns of their own. Rows with a null conversation are left out. Turns are equal if role and text are
    (128-bit digests). An empty table gives no rows, not even a root; a turnless conversation belongs to the root alone.
    Other columns, whatever their names, do not matter. Conversation and turn must be integers (TypeError).
    """
    return trie(branched(ranked_turns(df, **columns, sizes=sizes), group, heads), sizes)
