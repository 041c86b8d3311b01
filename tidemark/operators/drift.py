"""Drift between two distributions over the same cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas as S

EPSILON = 1e-12


def jensen_shannon(cells: DataFrame, left: str, right: str, epsilon: float = EPSILON) -> DataFrame:
    """One row with `js`, base 2; epsilon is added to every cell before both are made to sum to one."""
    total = cells.agg(F.sum(F.col(left) + epsilon).alias("tp"), F.sum(F.col(right) + epsilon).alias("tq"))  # one row
    p = cells.join(F.broadcast(total)).select(((F.col(left) + epsilon) / F.col("tp")).alias("p"), ((F.col(right) + epsilon) / F.col("tq")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part: Column = 0.5 * F.col("p") * F.log2(F.col("p") / m) + 0.5 * F.col("q") * F.log2(F.col("q") / m)
    return p.agg(F.sum(part).alias("js"))


def live_counts(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """item_id, live: the events of every item that the model knows, zeros included."""
    counts = events.groupBy("item_id").agg(F.count("*").alias("live"))
    return vocabulary.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("live", F.lit(0)).alias("live"))


def action_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count("*").alias("n"))


def detect(events: DataFrame, trained: DataFrame, threshold: float = S.DRIFT_WARNING, version: str | None = None) -> dict:
    """The drift report: live traffic against `trained` (item_id, popularity) of a model."""
    cells = trained.join(live_counts(events, trained), "item_id")
    js = jensen_shannon(cells, "popularity", "live").first().js
    observed = cells.agg(F.sum("live").alias("n")).first().n or 0
    return {
        "status": "warning" if observed and js >= threshold else "healthy",
        "model_version": version,
        "observed_events": int(observed),
        "item_distribution_js": js,
        "warning_threshold": threshold,
        "action_counts": {r.action: r.n for r in action_counts(events).orderBy("action").collect()},
    }
