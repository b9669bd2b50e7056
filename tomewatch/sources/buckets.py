"""Tables kept in hash buckets of their key: an upsert reads and rewrites the buckets that its batch touches, and no other file.

An upsert is prepared, then applied. Preparing writes the new content of the touched buckets beside the table, under the
batch's number; applying moves a copy of it over those buckets by dynamic partition overwrite. Either step can be repeated:
a batch that was interrupted anywhere ends in the same table when it is run again under its number.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``; only runs that do not set it get a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="spark-")
    return f"{base}/work-{uuid.uuid4().hex}"


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write into ``folder`` has ended."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_once(df: DataFrame, folder: str, batch: int) -> DataFrame:
    """``df`` under its batch's number in ``folder``, written unless that has been done, and read again."""
    path = f"{folder}/batch={batch}"
    if not is_complete(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class BucketedTable:
    """A table of one row a key below ``path``, in ``n`` buckets, each written by as many tasks as the session's shuffle partitions allow.

    A row's bucket is the remainder of the hash that also deals rows over tasks, so tasks whose number is a multiple of ``n`` hold
    rows of one bucket each: rows dealt for a join by the keys are written where they are, without another shuffle.
    """

    path: str
    keys: tuple[str, ...]
    schema: str
    n: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.n)).cast("int")

    def create(self, df: DataFrame) -> BucketedTable:
        """The table with its first rows, or none."""
        self._dealt(df).withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(self.path)
        return self

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets (other buckets' files are not opened)."""
        rows = spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.path).parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch's keys: at most ``n`` numbers."""
        return sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())

    def prepare(self, batch: DataFrame, number: int, rules: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The touched buckets after ``rules(old rows, batch)``, written beside the table under the batch's number.

        Both sides come dealt by the keys. Rules that join them by the keys leave every row in its bucket's task; others give more files.
        """
        spark, folder = batch.sparkSession, f"{self.path}.next/batch={number}"
        schema = spark.createDataFrame([], self.schema).schema
        if not is_complete(spark, folder):
            after = rules(self._dealt(self.read(spark, self.touched(batch))), self._dealt(batch)).select(*[F.col(f.name).cast(f.dataType) for f in schema])
            after.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return spark.read.schema(f"{self.schema}, bucket int").option("basePath", folder).parquet(folder)

    def apply(self, prepared: DataFrame) -> None:
        """Put prepared buckets in the place of the table's; a file holds rows of one bucket, so they need no dealing."""
        prepared.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def upsert(self, batch: DataFrame, number: int, rules: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self.apply(self.prepare(batch, number, rules))

    def _dealt(self, df: DataFrame) -> DataFrame:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(self.n * max(1, round(tasks / self.n)), *self.keys)
