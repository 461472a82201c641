"""A training corpus from raw documents: STAGES in order, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.llm import classify, decontaminate, mixing, near_dedup, pii
from maskmill.llm.queries import MIX_WEIGHTS
from maskmill.llm.shared import cut, fold_of


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go. The model learns from labelled documents of the learning folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify.classify(docs, labels, "toxic", "factors", 0.5, held_out=fold_of("doc_id") == 0)
    toxic = judged.where(F.col("predicted") == 1).select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data and the words that give it away are replaced in the text, n_chars follows it."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, each with its place in a mix of the sources by their target weights."""
    return mixing.mix(docs, MIX_WEIGHTS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]
#: SQL expresses neither the learned stage nor the disclosure model; tests hold each stage, and its operator, against what it says.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
