"""From raw documents to packed training sequences: each stage works on what its predecessor kept, written as Parquet in between.

All stages but the last return the rows they keep with all columns of documents, extra ones included, whatever their names. Null texts count as
empty, empty and very long texts are texts like others, ids may be null or repeated, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import stored
from wardline.llm.decontaminate import clean
from wardline.llm.packing import pack
from wardline.llm.quality import good
from wardline.llm.simhash import one_of_each
from wardline.llm.toxicity import civil


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Repeated rows go or stay together; where the labels tell nothing, all stay."""
    return civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rated too low go. Repeated rows go or stay together; where no document is rated, all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good(docs, labels.select("doc_id", F.col("quality").alias("grade")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id. Rows of equal id and text count once, rows without an id stay only in
    groups without any, and texts without words are one group."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. An empty benchmark keeps all; items too short to tell apart match nothing."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences: every token once. Rows of one id, or without one, are documents of their own; an empty text is its end id."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: The stages hold fitted models, fingerprints and a tokenizer, which DuckDB has not; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
