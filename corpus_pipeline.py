"""From raw documents to packed batches: five stages, each an operator of factorlake.llm.

Every stage works on all that its predecessor kept, and returns the columns of documents but
for the last. Tables with nulls, repeated rows or no rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import decontaminate, line_dedup, ngram_join, packing, quality
from factorlake.llm.scratch import kept, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject; rejected are scores under 0.7."""
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.with_score(docs, model, out="__score").where(F.col("__score") >= 0.7).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with __key, a number of each row's own, written as a table, so that rows without an id, or of one id, are rows like others."""
    return kept(docs.withColumn("__key", F.monotonically_increasing_id()), "numbered")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least id, rows without one last."""
    rows = numbered(docs)
    found = ngram_join.near_duplicates(rows, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id")
    first = F.min_by("__key", F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))
    stay = found.join(rows.select("__key", "doc_id"), "__key").groupBy("component_id").agg(first.alias("__key")).select("__key")
    return rows.join(stay, "__key", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage."""
    rows = numbered(docs)
    own = rows.select(F.col("__key").alias("doc_id"), "text")
    leaks = decontaminate.contaminated(own, table(spark, sf_dir, "benchmark", "item_id", "text")).select(F.col("doc_id").alias("__key")).distinct()
    return rows.join(leaks, "__key", "left_anti").select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in token-budget batches of optimal length buckets."""
    return packing.pack(docs, ["doc_id"], packing.word_count(F.col("text")), n_buckets=16, budget=65_536)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_batches),
]

#: The classifier and the alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
