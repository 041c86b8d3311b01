"""The tables of the engine and the constants that fix its semantics."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _of(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _D, _I, _L, _T = StringType(), DoubleType(), IntegerType(), LongType(), TimestampType()

ITEMS = _of(item_id=_S, title=_S, genres=ArrayType(_S), year=_I, quality=_D, freshness=_D, color=_S)
#: The canonical columns of a viewing event; time is in seconds since the epoch.
EVENTS = _of(event_id=_S, user_id=_S, item_id=_S, action=_S, timestamp=_D, watch_pct=_D)
EVENT_COLUMNS = [f.name for f in EVENTS]
LOG = StructType([StructField("source_offset", _L), *EVENTS.fields])
EXPOSURES = _of(request_id=_S, user_id=_S, item_id=_S, position=_I, experiment=_S, variant=_S, score=_D, timestamp=_D, model_version=_S, serving_mode=_S)
#: The event on the wire: RFC 3339 time, no other fields.
WIRE = _of(schema_version=_I, event_id=_S, user_id=_S, item_id=_S, action=_S, event_time=_S, watch_pct=_D, session_id=_S, trace_id=_S)
WIRE_REQUIRED = ["schema_version", "event_id", "user_id", "item_id", "action", "event_time", "watch_pct"]
BROKER = _of(topic=_S, partition=_I, offset=_L, broker_time=_T, message_key=_S, raw_json=_S)
SILVER = StructType([*LOG.fields, StructField("repaired", BooleanType())])
LATE = StructType([*LOG.fields, StructField("watermark", _D), StructField("lateness_seconds", _D)])

# The semantics of events, ranking, experiments and models.
ACTIONS = ("impression", "play", "complete", "like", "skip")
WEIGHTS = {"impression": "0.0", "play": "0.8", "complete": "2.2", "like": "3.0", "skip": "-2.5"}
WATCH_FLOOR = "0.15"
WATCHED = ("play", "complete")
POPULAR = ("play", "complete", "like")
POSITIVE = ("like", "complete")
RECENT = 12
ID_LENGTH = 128
TASTE_SHARE, POPULARITY_SHARE = 0.70, 0.30
COLD_QUALITY, COLD_FRESHNESS = 0.65, 0.35
CONTROL = (0.62, 0.38, 0.0)
CHALLENGER = (0.55, 0.27, 0.18)
DIVERSITY_PENALTY = 0.075
SLATE = 12
BUCKETS = 10_000
WINDOW_DAYS = 7
GUARDRAIL_N, GUARDRAIL_Z = 30, -2.576
WATERMARK_SECONDS = 600
LABEL_POSITIVE_WATCH, LABEL_NEGATIVE_WATCH = 0.6, 0.4
MIN_POSITIVES = 5
NDCG_LIFT = 0.02
DRIFT_WARNING = 0.10
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
