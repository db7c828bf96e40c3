"""A corpus preparation run: each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import decontaminate, near, pieces, pii, quality
from reviewlake.llm.common import new_path, read_table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null text is scored as the empty one."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more) stays: that of the smallest id.
    Null and empty texts are one group."""
    return near.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; a null text has no words and stays."""
    judged = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return judged.filter("NOT contaminated").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes, and a null text stays null."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of them and of the text decoded again; a null text has none."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(docs, model, ids_too=True).drop("text")


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("pii", private), ("sentencepiece", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
