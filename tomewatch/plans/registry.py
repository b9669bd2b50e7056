"""Registered queries and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import work_folder
from .fixtures import oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rows of a lookup that a broadcast may hold.
FEW = 100_000


class Tables:
    """Catalogue tables by attribute: ``t.shop_books``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.kept = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name, self.kept)

    def keep(self, *names: str, columns: tuple[str, ...] = ()) -> Tables:
        """Store views, or some columns of them, as tables, as a catalogue holds them, so that what reads them several times does not derive them again."""
        folder = work_folder(self.spark)
        for name in names:
            df = getattr(self, name).select(*columns or "*")
            df.write.parquet(f"{folder}/{name}")
            self.kept[name] = self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        return self

    def named(self, lookup: DataFrame, by: DataFrame, key: str, rows: int = FEW) -> DataFrame:
        """The rows of ``lookup`` whose id is in ``by[key]``, stored; if they are few they come by broadcast, so that what names them is not shuffled."""
        ids = by.select(F.col(key).alias("id")).distinct()
        folder = work_folder(self.spark)
        lookup.join(ids, "id", "left_semi").write.parquet(folder)
        out = self.spark.read.schema(lookup.schema).parquet(folder)
        return F.broadcast(out) if out.count() <= rows else out


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``, with SQL over {views} as its oracle."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return keep


from . import queries_items, queries_quality, queries_reads, queries_text  # noqa: E402, F401
