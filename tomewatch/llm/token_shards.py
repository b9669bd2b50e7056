"""Training-order materialisation: token sequences dealt to global slots by a keyed permutation, in fixed-stride shards."""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder
from .kernels import U, mix

#: Byte-level BPE ranks with 50,256 entries; id 50256 ends a document and fills its last sequence.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256
# Fixed value: how this vocabulary splits text before merging ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+), in
# a form that gives the same pieces without going back.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Tokens of a sequence, and sequences of a shard.
SEQUENCE, SHARD = 512, 4096
ROUNDS = 4
#: Runs of white space that are cut out before the pattern, whose matcher cannot go through very long ones.
_LONG_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def vocabulary(path: str) -> bytes:
    """The file of ranks, read on the driver; tasks get it by broadcast (some 800 KB)."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    """The encoding of a file of ranks, made once in a worker."""
    import tiktoken

    ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    if max(ids.values()) > 0xFFFF:
        raise OverflowError("the vocabulary has ids above 65,535")
    # the end token's name is never allowed in a text, so a text that holds it is encoded like any other
    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={"<|endoftext|>": END})


def token_ids(encoding, text: str | None) -> np.ndarray:
    """Token ids of a whole text; null is empty.

    A run of white space before other characters gives all but its last one as a piece of its own, and one at the end
    is a piece, so very long runs are encoded apart with the same result.
    """
    plain = lambda t: encoding.encode_to_numpy(t, disallowed_special=())
    if not text:
        return np.empty(0, np.uint32)
    if len(text) < 10_000 or not (long := _LONG_SPACE.search(text)):
        return plain(text)
    out, at = [], 0
    while long:
        last = long.end() if long.end() == len(text) else long.end() - 1
        out += [plain(text[at : long.start()]), np.array(encoding._encode_single_piece(text[long.start() : last]), np.uint32)]
        at, long = last, _LONG_SPACE.search(text, long.end())
    return np.concatenate([*out, plain(text[at:])])


def encode(encoding, text: str | None) -> list[int]:
    """``token_ids`` as a list."""
    return token_ids(encoding, text).tolist()


def permute(at: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts each of ``at``.

    A balanced Feistel network permutes the smallest domain of an even number of bits that holds n; a result
    beyond n walks on through the network until it falls below n, which keeps the map one to one.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)
    keys = mix(np.arange(rounds, dtype=np.uint64) + U(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = at.astype(U)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> U(half), out[walk] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[walk] = (left << U(half)) | right
        walk = walk[out[walk] >= U(n)]
    return out.astype(np.int64)


def training_order(
    docs: DataFrame, key: int = 11, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, shard: int = SHARD,
    id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None,
) -> DataFrame:
    """Token sequences of all documents in training order.

    Every document becomes its tokens and an end token, cut into sequences of ``sequence`` tokens; the last one
    is filled with end tokens. All N sequences are numbered and a keyed Feistel permutation with cycle-walking
    gives each its slot in 0..N-1. Returns, sorted by slot inside range partitions of whole shards: slot,
    shard (slot div ``shard``), byte_offset (in the shard, slot mod ``shard`` times the stride of 2 *
    ``sequence`` bytes), the id, seq_no, n_tokens (without filling) and tokens (exactly the stride).
    ``with_shards`` and ``write_shards`` put the tokens into files of that layout, ``read_slots`` reads them on from any slot.

    A first pass counts the sequences of every block of the input, a second one numbers them from its block's
    first number, so texts of a sequence's bytes and more are tokenised twice and tokens are never stored but in the one shuffle by ranges of slots.
    Both passes must meet the same rows in every block. If all rows come from files without a shuffle, blocks are those
    of the files (``spark.sql.files.minPartitionNum`` is set if it is not, so that they do not move with the number
    of executors); otherwise the texts are kept in a shared checkpoint and its partitions are the blocks. A task that
    counts otherwise than the first pass did fails instead of giving wrong slots. The driver gets two numbers a block. Slots are uniform, so ranges of them are even however skewed the documents are.
    Vocabularies must have ids below 65,536.

    A null or empty text gives one sequence with the end token alone. Repeated rows and null ids are kept as
    rows of their own. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    ranks = spark.sparkContext.broadcast(vocabulary(tokenizer))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    of_file = F.when(F.input_file_name() != "", F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    stride = 2 * sequence

    def count(batches):
        for b in batches:
            held: dict[int, int] = {}
            for k, t, size in zip(b.column(0).to_pylist(), b.column(1), pc.binary_length(b.column(1)).to_pylist(), strict=True):
                # a token covers a byte at least, so a text of fewer bytes fills no sequence
                full = len(token_ids(encoder(ranks.value), t.as_py())) // sequence if (size or 0) >= sequence else 0
                held[k] = held.get(k, 0) + full + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["block", "n"])

    def counted(blocks: DataFrame):
        counts = blocks.select("block", "text").mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
        return counts.orderBy("block").toPandas()

    blocks = texts.select(of_file.alias("block"), "id", "text")
    counts = counted(blocks)
    if counts["block"].isna().any():
        blocks = checkpointed(texts).select(F.spark_partition_id().cast("long").alias("block"), "id", "text")
        counts = counted(blocks)
    ends = np.cumsum(counts["n"].to_numpy(dtype=np.int64))
    total = int(ends[-1]) if len(ends) else 0
    numbers = spark.sparkContext.broadcast((counts["block"].to_numpy(dtype=np.int64), np.append(0, ends)))

    def run(batches):
        known, bounds = numbers.value
        end = END.to_bytes(2, "little")
        now, number, bound = None, 0, 0

        def rows(data, owner, seq, filled, part, first):
            slot = permute(np.arange(first, first + len(data)), total, key)
            return pa.RecordBatch.from_arrays(
                [pa.array(slot), part.column(1).take(pa.array(owner)), pa.array(seq, pa.int32()), pa.array(filled, pa.int32()), pa.array(data, pa.binary())],
                ["slot", id_col, "seq_no", "n_tokens", "tokens"],
            )

        for b in batches:
            data, owner, seq, filled = [], [], [], []
            first = number
            for k, (block, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
                if block != now:
                    at = int(np.searchsorted(known, block))
                    if number != bound or at == len(known) or known[at] != block:
                        raise RuntimeError("the blocks of the input changed between counting and numbering")
                    if data:
                        yield rows(data, owner, seq, filled, b, first)
                        data, owner, seq, filled = [], [], [], []
                    now, number, bound = block, int(bounds[at]), int(bounds[at + 1])
                    first = number
                tokens = token_ids(encoder(ranks.value), t.as_py()).astype("<u2").tobytes() + end
                for s in range(0, len(tokens), stride):
                    piece = tokens[s : s + stride]
                    data.append(piece + end * ((stride - len(piece)) // 2))
                    owner.append(k)
                    seq.append(s // stride)
                    filled.append(len(piece) // 2)
                    number += 1
                    if number > bound:
                        raise RuntimeError("the blocks of the input changed between counting and numbering")
                    if len(data) == 1000:
                        yield rows(data, owner, seq, filled, b, first)
                        data, owner, seq, filled, first = [], [], [], [], number
            if data:
                yield rows(data, owner, seq, filled, b, first)
        if number != bound:
            raise RuntimeError("the blocks of the input changed between counting and numbering")

    rows = blocks.mapInArrow(run, f"slot long, `{id_col}` {kind}, seq_no int, n_tokens int, tokens binary")
    shards = max(1, -(-total // shard))
    width = min(shards, partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * stride // (64 << 20) + 1))
    of_shard = F.floor(F.col("slot") / shard).cast("long")
    dealt = rows.repartitionById(width, F.floor(of_shard * width / shards).cast("int"))
    layout = {"slots": total, "sequence": sequence, "shard": shard}
    return dealt.sortWithinPartitions("slot").select(
        "slot", of_shard.alias("shard", metadata=layout), (F.col("slot") % shard * stride).alias("byte_offset"), id_col, "seq_no", "n_tokens", "tokens"
    )


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


MANIFEST = "manifest.json"


def with_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """The rows of ``training_order`` with the ``path`` of their shard, which is written as they pass.

    ``folder`` is a path or URI of a file system that all machines reach (any that Arrow opens: local mounts, HDFS,
    object stores). A manifest (count of slots, slots of a shard, tokens of a sequence) is written there first, so a reader
    knows what must be there. A shard lies in one partition, in order, and is written under a name of the task's own and
    then moved, unless an earlier attempt of the task has put it there: a repeated or doubled task leaves the same whole
    file. It is there once its task ended, so only a consumer that takes all rows has all shards; ``read_slots`` tells.
    What a lost task leaves below ``_temporary`` can be deleted at any time. Nothing is sorted or shuffled again.
    """
    names = [f.name for f in ordered.schema.fields]
    at_shard, at_tokens = names.index("shard"), names.index("tokens")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    with store.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps(ordered.schema["shard"].metadata).encode())

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        now, out, name = None, None, ""

        def close():
            if out:
                out.close()
                put(store, name, shard_path(root, now))

        for b in batches:
            path = []
            for shard, tokens in zip(b.column(at_shard).to_pylist(), b.column(at_tokens), strict=True):
                if shard != now:
                    close()
                    now, name = shard, f"{root}/_temporary/shard-{shard:08d}-{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(name)
                out.write(tokens.as_buffer())
                path.append(shard_path(folder, shard))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(path, pa.string())], [*names, "path"])
        close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    return ordered.mapInArrow(run, f"{schema}, path string")


def put(store: fs.FileSystem, name: str, target: str) -> None:
    """Move a finished file to its place, or drop it where another attempt has put the same file, before or meanwhile."""
    there = lambda: store.get_file_info(target).type == fs.FileType.File
    if not there():
        try:
            store.move(name, target)
            return
        except OSError:
            if not there():
                raise
    store.delete_file(name)


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write the shards of ``with_shards``; one row (shard, path, sequences, bytes) a file."""
    written = with_shards(ordered.select("shard", "tokens"), folder)
    return written.groupBy("shard", "path").agg(F.count("*").alias("sequences"), F.sum(F.octet_length("tokens")).cast("long").alias("bytes"))


def read_slots(folder: str, slot: int = 0) -> Iterator[np.ndarray]:
    """Sequences in training order from ``slot`` on, as a reader resumes: one seek in one shard, then reads in order.

    The folder's manifest says how many there are; FileNotFoundError without it or without a shard that it counts, and
    ValueError at a shard of another length. Nothing comes from the last slot on.
    """
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{MANIFEST}") as f:
        layout = json.loads(f.read())
    stride, shard, slots = 2 * layout["sequence"], layout["shard"], layout["slots"]
    while slot < slots:
        path, first = shard_path(root, slot // shard), slot // shard * shard
        info, size = store.get_file_info(path), (min(first + shard, slots) - first) * stride
        if info.type != fs.FileType.File:
            raise FileNotFoundError(f"{path} is missing: slots {first} to {slots - 1} cannot be read in order")
        if info.size != size:
            raise ValueError(f"{path} has {info.size} bytes, not {size}")
        with store.open_input_file(path) as f:
            f.seek((slot - first) * stride)
            while piece := f.read(stride):
                yield np.frombuffer(piece, "<u2")
                slot += 1


def shard_folder(spark: SparkSession) -> str:
    """The URI of a new folder for shards in the shared one."""
    base = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    return f"{base if '://' in base else 'file://' + base}/shards-{uuid.uuid4().hex}"
