"""From raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import work_dir

STAGES = [
    ("quality_classifier", stages.quality),
    ("simhash_near_dedup", stages.near_dedup),
    ("secret_scan", stages.secret_scan),
    ("source_mixing", stages.source_mixing),
    ("bpe_encoding", stages.encoding),
]

#: The classifier is trained, and its scores are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
