"""Catalogue and event tables: validated, idempotent, conflict-safe writes, and the scans over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas as S
from tidemark.functions.events import unused
from tidemark.sources.tables import settle


class ConflictError(ValueError):
    """An event id came with other content than before."""


def latest(items: DataFrame, key: str = "item_id", order: str = "seq") -> DataFrame:
    """Upsert: of the rows with one key the one written last, by `order`."""
    last, n = Window.partitionBy(key).orderBy(F.desc(order)), unused(items.columns, "n")
    return items.withColumn(n, F.row_number().over(last)).filter(F.col(n) == 1).drop(n)


def put_items(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalogue with `fresh` rows in place of known ones of the same item_id."""
    both = known.withColumn("seq", F.lit(0)).unionByName(fresh.withColumn("seq", F.lit(1)))
    return latest(both).drop("seq")


def scan_items(items: DataFrame) -> DataFrame:
    return items.orderBy("item_id")


def item(items: DataFrame, item_id: str) -> DataFrame:
    return items.filter(F.col("item_id") == item_id)


def scan(events: DataFrame, user_id: str | None = None, as_of: float | None = None, ordered: bool = True) -> DataFrame:
    """Events of a user (of all, if none is given) up to and including as_of, by (timestamp, event_id)."""
    if user_id is not None:
        events = events.filter(F.col("user_id") == user_id)
    if as_of is not None:
        events = events.filter(F.col("timestamp") <= as_of)
    return events.orderBy("timestamp", "event_id") if ordered else events


def log(events: DataFrame, after: int = 0, limit: int = 1000) -> DataFrame:
    """The next `limit` events behind an offset, in order of arrival."""
    return events.filter(F.col("source_offset") > after).orderBy("source_offset").limit(limit)


def rejection(action: str = "action", watch: str = "watch_pct", time: str = "timestamp") -> Column:
    """Why a raw event is invalid, or null. Every column may be a string; times and shares must be finite numbers."""
    share, at = (F.expr(f"try_cast({c} AS double)") for c in (watch, time))
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("action", "event_id", "item_id", "timestamp", "user_id"))), lambda x: x.isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(~F.col(action).isin(*S.ACTIONS), F.lit("invalid action"))
        .when(F.col(watch).isNotNull() & ~(finite(share) & share.between(0, 1)), F.lit("watch_pct must be between 0 and 1"))
        .when(~finite(at), F.lit("timestamp must be a finite number"))
    )


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of raw rows: the canonical columns with a default share of 0; raw rows with their reason."""
    known = raw.withColumn("reason", rejection())
    typed = known.filter("reason is null").select(
        *(F.col(c).cast("string").alias(c) for c in ("event_id", "user_id", "item_id", "action")),
        F.col("timestamp").cast("double").alias("timestamp"),
        F.coalesce(F.col("watch_pct").cast("double"), F.lit(0.0)).alias("watch_pct"),
    )
    return typed, known.filter("reason is not null")


def conflicts(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Ids with more than one content, among the events at hand and those stored, which events must hold together."""
    return events.select(S.EVENT_COLUMNS).distinct().groupBy(key).agg(F.count("*").alias("contents")).filter("contents > 1")


@dataclass(frozen=True)
class Ingested:
    accepted: int
    duplicates: int


def ingest(known: DataFrame, batch: DataFrame) -> tuple[DataFrame, Ingested]:
    """(the events to append, counts). A repeated event is a duplicate; one id with two contents stops the batch.

    Only stored events whose ids are in the batch are looked at; the batch decides how much is compared.
    """
    own = known.select(S.EVENT_COLUMNS).join(batch.select("event_id").distinct(), "event_id", "left_semi")
    clash = conflicts(own.unionByName(batch.select(S.EVENT_COLUMNS))).select("event_id").limit(1).collect()
    if clash:
        raise ConflictError(f"event {clash[0].event_id} already exists with different content")
    # Settled: what is counted is what the caller writes, though the stored events change in between.
    fresh = settle(batch.select(S.EVENT_COLUMNS).join(own.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"]))
    accepted, total = fresh.count(), batch.count()
    return fresh, Ingested(accepted, total - accepted)


def record_exposures(known: DataFrame, rows: DataFrame) -> DataFrame:
    """The exposures to append: those whose (request, item) isn't stored, the first of repeated ones."""
    return rows.join(known.select("request_id", "item_id"), ["request_id", "item_id"], "left_anti").dropDuplicates(["request_id", "item_id"])


def scan_exposures(exposures: DataFrame, experiment: str | None = None) -> DataFrame:
    if experiment is not None:
        exposures = exposures.filter(F.col("experiment") == experiment)
    return exposures.orderBy("timestamp", "request_id", "position")


def stats(items: DataFrame, events: DataFrame, exposures: DataFrame) -> DataFrame:
    """One row: items, events, users, exposures."""
    e = events.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    return items.agg(F.count("*").alias("items")).join(e).join(exposures.agg(F.count("*").alias("exposures")))


def add_missing(df: DataFrame, schema) -> DataFrame:
    """An older table in the columns of `schema`: missing ones are null, serving_mode is heuristic."""
    own = set(df.columns)
    default = {"serving_mode": F.lit("heuristic")}
    return df.select(*(F.col(f.name) if f.name in own else default.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
