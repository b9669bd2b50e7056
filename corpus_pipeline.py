"""A corpus pipeline over ``documents``: each stage reads what the one before wrote as Parquet.

Stages but the last return the columns of documents. All work on whole texts of all rows they get.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewatch.llm import language_id
from tomewatch.llm.common import checkpointed, read, shared_folder, small_batches
from tomewatch.llm.decontaminate import find_leaks
from tomewatch.llm.jaccard_join import jaccard_components
from tomewatch.llm.mixing import poisson_mix
from tomewatch.llm.token_shards import shard_folder, training_order, with_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language is undetermined; ``lang`` becomes the predicted one.

    Undetermined are null and empty texts, texts without a letter, and texts none of whose n-grams any language of
    ``docs`` contains (score 0). Filters are trained on the rows of ``docs`` with a language; ties go to the first
    name. Repeated rows and null ids are judged like any row; further columns are dropped; an empty table stays empty.
    """
    small_batches(spark)
    model = language_id.train(docs)
    judged = language_id.identify(docs, model, keep=("text", "source", "n_chars"))
    kept = judged.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") > 0))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies (word 5-grams, similarity 0.8).

    Texts without words (null, empty) are no copies and stay. If an id is null or repeated, rows are numbered by id
    first (nulls before others, equal ids in any order) and judged by their numbers, so of rows that repeat an id and
    a text one stays, and rows that share an id but no text both stay. Further columns are dropped; an empty table
    stays empty.
    """
    small_batches(spark)
    near = {"n": 5, "num": 80, "den": 100}
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        groups = jaccard_components(docs, **near)
        dropped = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
        return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)
    numbered = checkpointed(docs.orderBy("doc_id").select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    groups = jaccard_components(numbered, id_col="_row", **near)
    return numbered.join(groups.where("_row <> component_id").select("_row"), "_row", "left_anti").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the table ``benchmark``, verbatim or as a paraphrase.

    Null and empty texts hold none and stay; items without text are none. Repeated rows are judged alike, null ids like any
    id; further columns are dropped; an empty table of documents stays empty, an empty benchmark drops nothing.
    """
    judged = find_leaks(docs, read(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars"))
    return judged.where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources weigh the same, in one global shuffle.

    A document's number of copies is Poisson by a hash of its id, so it may be none. A null source is a source; rows of
    one id get equal numbers and stay apart; texts do not matter. Further columns are dropped; an empty table stays empty.
    """
    return poisson_mix(docs).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, written to shards of the shared folder as they are read.

    Returns the rows of ``training_order`` and the path of each one's shard. Null and empty texts give one sequence
    with the end token alone; repeated rows and null ids are rows of their own; an empty table writes no shard.
    """
    small_batches(spark)
    return with_shards(training_order(docs), shard_folder(spark))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Learned filters, components and tokenisation have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
