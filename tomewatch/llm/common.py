"""Session helpers shared by the operators: shared checkpoints, table reads and bounded filters."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch of whole texts; Spark's defaults would hand a worker tens of MB at once.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 1000, 1 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of whole texts small enough for a Python worker, unless the session already sets a size."""
    for name, default, value in (("maxRecordsPerBatch", "10000", TEXT_BATCH_ROWS), ("maxBytesPerBatch", None, TEXT_BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in a local run without it a temporary one."""
    sc = spark.sparkContext
    if set_by_cluster := sc.getConf().get("spark.checkpoint.dir", ""):
        return set_by_cluster
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, cutting its lineage; plans that nothing refers to any more leave the driver."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    gc.collect()
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: lineage is cut as by a checkpoint, in less space."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def integer_ids(df: DataFrame, col: str) -> Column:
    """Column ``col`` as long; other than integer columns are refused, as a cast would make nulls of their values."""
    kind = df.schema[col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{col} must be an integer column, not {kind}: number the rows first")
    return F.col(col).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, null as empty; every other character stays as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


#: Slots of an id filter; its size (512 KB) does not depend on the input.
FILTER_SLOTS = 1 << 22


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A fixed-size bitmap with a bit for ``id mod FILTER_SLOTS`` of every id in ``col``.

    It only thins rows before an exact join; a full bitmap lets every row through.
    """
    slot = F.pmod(F.col(col).cast("long"), F.lit(FILTER_SLOTS))
    words = (
        ids.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(FILTER_SLOTS >> 6, dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out


def may_hold(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of ``ids`` may be in an ``id_filter`` bitmap."""
    slot = np.mod(ids, FILTER_SLOTS)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node, root the smallest node.

    Alternates large-star and small-star joins until the edges no longer change, with a shared
    checkpoint a round; the rounds grow with the logarithm of the longest path. Nothing but one row of
    counts reaches the driver. Self-loops and repeated edges are harmless; an empty table gives none.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(low, "a")
        if small:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        else:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = checkpointed(e)
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or now[0] == 0:
            break
        mark = tuple(now)
        e = checkpointed(star(star(e, small=False), small=True))
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def broadcast_if_bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.count() <= rows else df


#: A key is hot from this many rows on and from this part of all rows on, so at most HOT_PARTS keys are.
HOT_ROWS, HOT_PARTS = 10_000, 1_000


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``lookup`` (one row a key), hot keys apart so that none of them lands in one task.

    At most HOT_PARTS keys can hold one in HOT_PARTS of all rows; their rows meet a broadcast of those keys' lookups.
    Both tables are read more than once, so they should be materialised.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = checkpointed(counts.where(F.col("_n") >= F.greatest(F.lit(hot_rows), F.lit(rows.count()) / HOT_PARTS)).select(key))
    if hot.isEmpty():
        return rows.join(lookup, key)
    few = F.broadcast(lookup.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(few, key).union(rows.join(F.broadcast(hot), key, "left_anti").join(lookup, key).select(*rows.join(few, key).columns))
