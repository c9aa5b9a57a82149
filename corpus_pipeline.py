"""A training corpus from raw documents: each stage is one corpus operator, written as Parquet and read again by the next.

quality      documents that the line classifier scores below 0.7 go
lines        later occurrences of three-line windows go, and documents of which nothing is left
near_copies  of each group of near-duplicates (five-word shingles, 0.8 similar or more; candidates from SimHash groups and minimum
             hashes) the document with the least id stays
personal     personal data in the texts is masked
packing      the texts are packed into sequences; one row for each piece of a document
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import linededup, packing, pii, simhash
from tideline.llm import quality as line_quality
from tideline.llm.common import stage


#: Names of the lines stage's own columns, which no table brings along.
COUNTS = ("__tideline_lines", "__tideline_removed")


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = linededup.drop_repeated_lines(docs, counts=COUNTS)
    return _with_length(left.where(f"{COUNTS[1]} = 0 or text != ''").drop(*COUNTS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, words=5, least=0.8)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("personal", personal), ("packing", pack)]

#: Not expressible in SQL: the first stage is a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
