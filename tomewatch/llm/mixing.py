"""Mixing sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_bounded, checkpointed

#: Most sources whose rates are broadcast (four numbers each).
BROADCAST_SOURCES = 10_000
#: Copies of a document that one task makes at a time; documents of sources above this rate are dealt in such blocks first.
BLOCK = 1_000


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) fixed by ``parts``: the leading 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_mix(
    df: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source",
    epochs: float = 1.0, seed: int = 17,
) -> DataFrame:
    """Repeat every document a Poisson number of times so that sources meet ``weights``, and shuffle all.

    ``weights`` maps a source (None for null) to its share of the output; None gives each source the same.
    The output has ``epochs`` times the input's rows on average, so a source of ``n_s`` rows gets the rate
    ``epochs * n * w_s / (sum of w * n_s)``. A row's count is the inverse Poisson distribution function at a
    uniform number hashed from seed and id: reruns and lost tasks repeat it exactly.

    Adds ``rate``, ``n_copies``, ``copy`` (0, 1, ...) and ``mix_key`` (a hash of seed, id and copy). Rows are dealt
    to partitions by ``mix_key`` and sorted by it inside them: a global shuffle in one exchange, without a pass that
    samples for ranges, in which a hot source or a much repeated document spreads over all tasks. Counts per
    source are pre-aggregated; the rates are broadcast only if they are few, else joined. A count takes steps as the root
    of its rate, so all counts together take no more steps than there are rows in the output, times a constant. Copies of
    documents of a steep rate are made by many tasks, a block of ``BLOCK`` at a time.

    Null sources are one source. Rows of one id, null included, get the same count and stay apart as rows.
    Columns of ``df`` named like an added one are replaced. A source without a weight gets rate 0. Empty tables and
    empty texts are ordinary input.
    """
    spark = df.sparkSession
    df = df.drop("rate", "n_copies", "copy", "mix_key")
    sizes = df.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_rows"))
    if weights is None:
        weighted = sizes.withColumn("_w", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "_key string, _w double")
        weighted = sizes.join(given, F.col("_source").cast("string").eqNullSafe(F.col("_key")), "left")
        weighted = weighted.select("_source", "_rows", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    weighted = checkpointed(weighted)
    rows, weight = weighted.agg(F.sum("_rows"), F.sum("_w")).first()
    rate = F.lit(epochs * (rows or 0)) * F.col("_w") / F.lit(weight or 1.0) / F.col("_rows")
    # the part of the distribution, 12 deviations and more to both sides, beyond which less than 2**-53 is left; pmf in units of its first
    low, high = F.expr("greatest(0, cast(floor(rate - 12 * sqrt(rate)) as int) - 30)"), F.expr("cast(floor(rate + 12 * sqrt(rate)) as int) + 30")
    total = F.expr("aggregate(sequence(_low, _high), named_struct('p', 1D, 'sum', 0D), (a, k) -> named_struct('p', a.p * rate / (k + 1), 'sum', a.sum + a.p), a -> a.sum)")
    rates = weighted.withColumn("rate", rate).where("rate > 0").withColumn("_low", low).withColumn("_high", high).select("_source", "rate", "_low", "_high", total.alias("_total"))
    rates = checkpointed(rates)
    # counts how many k have a distribution function of at most _u
    n = F.expr(
        "_low + aggregate(sequence(_low, _high), named_struct('p', 1D, 'sum', 0D, 'n', 0),"
        " (a, k) -> named_struct('p', a.p * rate / (k + 1), 'sum', a.sum + a.p, 'n', a.n + if(a.sum + a.p <= _u * _total, 1, 0)), a -> a.n)"
    )

    def drawn(some: DataFrame) -> DataFrame:
        some = broadcast_if_bounded(some, BROADCAST_SOURCES)
        with_rate = df.join(some, F.col(source_col).eqNullSafe(F.col("_source"))).withColumn("_u", hash_unit(F.lit(seed), F.col(id_col)))
        return with_rate.withColumn("n_copies", n).where("n_copies > 0").drop("_source", "_low", "_high", "_total", "_u")

    out = drawn(rates.where(F.col("rate") <= BLOCK)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    steep = rates.where(F.col("rate") > BLOCK)
    if not steep.isEmpty():
        blocks = drawn(steep).withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_copies - 1) div {BLOCK} as int)"))))
        dealt = blocks.repartition(F.xxhash64(F.col(id_col), F.col("_block")))
        each = F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("n_copies"), (F.col("_block") + 1) * BLOCK) - 1))
        out = out.unionByName(dealt.withColumn("copy", each).drop("_block"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")))
    return out.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")
