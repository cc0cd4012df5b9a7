"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all that its predecessor kept. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelmark.functions.tables import settle
from reelmark.llm import decontamination, line_dedup, mixing, near_dup, quality_model
from reelmark.llm.texts import unnested


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled ones of this stage's input, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = settle(quality_model.statistics(docs))
    return unnested(quality_model.with_scores(stats, quality_model.train(stats, labels)).filter("score >= 0.5"), docs)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them."""
    return line_dedup.deduplicated(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.one_of_each(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of ``copies``."""
    sizes = settle(mixing.sized(docs))
    taken = mixing.mix(sizes).filter("copies > 0").groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"))
    return mixing.with_copies(docs, taken)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", own_lines),
    ("near duplicates", unlike_documents),
    ("decontamination", unseen_documents),
    ("source mixing", mixed_documents),
]

# The classifier is trained and near duplicates are grouped by connectivity: not for SQL, see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
