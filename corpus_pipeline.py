"""A corpus pipeline of four operators and a near-duplicate stage on five-word shingles, each stage working on all that its predecessor kept.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All stages
but the last return the columns of documents: rows of an unknown or uncertain language,
toxic rows, and all but one of each group of near-duplicates go; from contaminated rows the
words of benchmark windows go, and the rows of which nothing is left. The last returns (doc_id, n_tokens, ids) of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import decontaminate, langid, neardup, pieces, toxicity
from quirespark.llm.common import fresh_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_rejected(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: No SQL: models are learned in two of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two of them is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
