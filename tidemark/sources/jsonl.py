"""JSON lines: appended by jobs, read with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.sources import files


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of a folder; none if it isn't there. Blank lines are skipped, and broken ones are rows of nulls."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append(rows: DataFrame, path: str) -> None:
    """Add files of records; a file appears when its job has committed."""
    rows.write.mode("append").json(path)
