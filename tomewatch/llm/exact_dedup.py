"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_PARTS, ascii_lower, checkpointed

#: Most shared lengths, surviving (length, prefix) groups and groups of copies that are broadcast: at most 48 bytes each, 24 MB.
BROADCAST_GROUPS = 500_000


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64,
    broadcast_groups: int = BROADCAST_GROUPS, keep: dict[str, Column] | None = None, digest: str | None = None,
) -> DataFrame:
    """Decide for every row whether it stays among rows of equal text.

    Returns the id, the columns of ``keep`` (the text by default) and ``keep_id`` (largest id of the group),
    ``group_size`` and ``kept``. Only built-in functions run. Texts travel only if they are kept: the last join
    moves the id, a hash and those columns. With ``digest``, every row's full hash (hexadecimal) is a column of that
    name; step 3 then takes it from there, hashed once a row.

    1. Rows whose byte length nobody shares are unique; no hash is computed for them.
    2. Of the others, rows whose hash of the first ``prefix_chars`` characters nobody of that length
       shares are unique.
    3. Only the rest is hashed whole (SHA-256) and grouped by that hash.

    Each step sends one pre-aggregated row per key and task, so a group of copies holding a third of all
    rows costs no more than another key. The lengths that are shared, the groups that survive step 2 and the groups of
    copies reach the scan by broadcast only if they are counted at ``broadcast_groups`` or fewer, else by a join on
    their key; lengths and groups of one in 1,000 of those rows or more, at most 1,000, are then joined apart by broadcast.

    Nulls count as empty text, and empty texts form one group. A null id sorts below any other; a group
    of null ids alone keeps a null ``keep_id`` and ``kept`` is true for one-row groups only. Rows that
    repeat an id and text in full are copies of each other: ``kept`` is true for each of them that has the
    largest id. An empty table gives an empty result. Further columns of ``df`` are not read.
    """
    keep = {text_col: F.col(text_col)} if keep is None else keep
    rows = df.select(F.col(id_col), F.col(text_col))
    norm = ascii_lower(F.col(text_col))
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    prefix = F.xxhash64(ascii_lower(F.substring(F.col(text_col), 1, prefix_chars)))

    lengths = checkpointed(rows.select(size.alias("_len")).groupBy("_len").agg(F.count("*").alias("n")).where("n > 1"))
    held, total = lengths.agg(F.count("*"), F.sum("n")).first()
    short = rows.select(size.alias("_len"), prefix.alias("_prefix"))
    if held <= broadcast_groups:
        shared = short.join(F.broadcast(lengths.select("_len")), "_len", "left_semi")
    else:
        hot = F.broadcast(lengths.where(F.col("n") >= total / HOT_PARTS).select("_len"))
        rest = short.join(hot, "_len", "left_anti").join(lengths.select("_len"), "_len", "left_semi")
        shared = short.join(hot, "_len", "left_semi").union(rest)
    groups = checkpointed(shared.groupBy("_len", "_prefix").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    survivors = groups.withColumn("_survives", F.lit(True))
    if groups.count() <= broadcast_groups:
        survivors = F.broadcast(survivors)

    staged = rows.withColumn("_len", size).withColumn("_prefix", prefix).join(survivors, ["_len", "_prefix"], "left")
    full = F.sha2(norm, 256)
    if digest:
        staged, keep, full = staged.withColumn("_full", full), {**keep, digest: F.col("_full")}, F.col("_full")
    hashed = staged.select(
        id_col,
        *[c.alias(f"_keep_{n}") for n, c in keep.items()],
        "_survives", "_len", "_prefix",
        # rows known to be unique get a key of their own (8 bytes, never a hash's 32), so that they spread over the join
        F.when(F.col("_survives"), F.unhex(full)).otherwise(F.unhex(F.hex(F.xxhash64(id_col, "_len", "_prefix")))).alias("_hash"),
    )
    copies = checkpointed(
        hashed.where(F.col("_survives"))
        .groupBy("_hash")
        .agg(F.max(id_col).alias("_max_id"), F.count("*").alias("_size"))
        .where("_size > 1")
    )
    if copies.count() <= broadcast_groups:
        joined = hashed.join(F.broadcast(copies), "_hash", "left")
    else:
        # groups of one in HOT_PARTS of all copies or more are few; their rows need no shuffle, the others' do
        hot = F.col("_size") >= F.lit(copies.agg(F.sum("_size")).first()[0] / HOT_PARTS)
        few = F.broadcast(copies.where(hot).select("_hash", F.col("_max_id").alias("_hot_id"), F.col("_size").alias("_hot_size")))
        spread = F.when(F.col("_hot_size").isNull(), F.col("_hash")).otherwise(F.unhex(F.hex(F.xxhash64(id_col, "_len", "_prefix"))))
        joined = hashed.join(few, "_hash", "left").withColumn("_hash", spread).join(copies.where(~hot), "_hash", "left")
        joined = joined.withColumn("_max_id", F.coalesce("_hot_id", "_max_id")).withColumn("_size", F.coalesce("_hot_size", "_size"))
    return joined.select(
        id_col,
        *[F.col(f"_keep_{n}").alias(n) for n in keep],
        F.when(F.col("_size").isNotNull(), F.col("_max_id")).otherwise(F.col(id_col)).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_size").isNull() | F.col(id_col).eqNullSafe(F.col("_max_id")) & F.col(id_col).isNotNull()).alias("kept"),
    )
