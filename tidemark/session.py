"""Sessions, and what Python workers need to find this package."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark


def build(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings: adaptive plans, UTC, RocksDB for streaming state."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if importlib.util.find_spec("delta"):  # tables are Delta where it is installed
        settings["spark.sql.extensions"] = "io.delta.sql.DeltaSparkSessionExtension"
        settings["spark.sql.catalog.spark_catalog"] = "org.apache.spark.sql.delta.catalog.DeltaCatalog"
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())
