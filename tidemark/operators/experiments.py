"""Experiment assignment by hash, outcome attribution, and variance-reduced readouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas as S
from tidemark.functions.events import bucket_of, hash_bucket

DAY = 86_400.0
SALT = "ns"


def assign(user: Column, experiment: str = "ranker-v1", salt: str = SALT, allocation: float = 50) -> dict[str, Column]:
    """experiment, bucket and variant of a user; `allocation` percent of the buckets are the challenger's."""
    if not 0 <= allocation <= 100:
        raise ValueError("allocation must be between 0 and 100")
    bucket = hash_bucket(salt, experiment, user)
    return {"experiment": F.lit(experiment), "bucket": bucket, "variant": F.when(bucket < int(S.BUCKETS * allocation / 100), "challenger").otherwise("control")}


def assigned(user: str, experiment: str = "ranker-v1", salt: str = SALT, allocation: float = 50) -> tuple[int, str]:
    bucket = bucket_of(salt, experiment, user)
    return bucket, "challenger" if bucket < int(S.BUCKETS * allocation / 100) else "control"


def mature_requests(exposures: DataFrame, as_of: float, window_days: float = S.WINDOW_DAYS) -> DataFrame:
    """request_id, user_id, variant, ts of the requests whose outcome window has passed; ts is that of the first row."""
    ripe = exposures.filter(F.col("timestamp") + F.lit(window_days * DAY) <= as_of)
    first = F.min_by(F.struct("user_id", "variant", "timestamp"), F.struct("timestamp", "position"))
    return ripe.groupBy("request_id").agg(first.alias("x")).select("request_id", "x.user_id", "x.variant", F.col("x.timestamp").alias("ts"))


def outcomes(exposures: DataFrame, events: DataFrame, as_of: float, window_days: float = S.WINDOW_DAYS) -> DataFrame:
    """request_id, converted (0 or 1): whether the user liked or finished a shown item after the request and within the
    window, its end included. Events join on user and item, so a busy user's events are dealt out by item."""
    w = window_days * DAY
    requests = mature_requests(exposures, as_of, window_days)
    shown = exposures.select("request_id", "item_id").distinct().join(requests, "request_id")
    good = events.filter(F.col("action").isin(*S.POSITIVE) & (F.col("timestamp") <= as_of)).select("user_id", "item_id", F.col("timestamp").alias("at"))
    hits = shown.join(good, ["user_id", "item_id"]).filter((F.col("at") > F.col("ts")) & (F.col("at") <= F.col("ts") + w)).select("request_id").distinct().withColumn("converted", F.lit(1))
    return requests.select("request_id").join(hits, "request_id", "left").select("request_id", F.coalesce("converted", F.lit(0)).alias("converted"))


def pre_period_counts(exposures: DataFrame, events: DataFrame, as_of: float, window_days: float = S.WINDOW_DAYS) -> DataFrame:
    """request_id, pre_period: the user's likes and completions in the window that ends just before the request.

    Requests and events are one stream for each user and a range frame counts, so no pair of request and event arises.
    """
    w = int(window_days * DAY * 1_000_000)
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    requests = mature_requests(exposures, as_of, window_days).select("user_id", micros("ts").alias("t"), "request_id", F.lit(0).alias("n"))
    good = events.filter(F.col("action").isin(*S.POSITIVE) & (F.col("timestamp") <= as_of)).select("user_id", micros("timestamp").alias("t"), F.lit(None).cast("string").alias("request_id"), F.lit(1).alias("n"))
    frame = Window.partitionBy("user_id").orderBy("t").rangeBetween(-w, -1)
    counted = requests.unionByName(good).withColumn("pre_period", F.coalesce(F.sum("n").over(frame), F.lit(0)))
    return counted.filter("request_id is not null").select("request_id", "pre_period")


def observations(exposures: DataFrame, events: DataFrame, as_of: float, window_days: float = S.WINDOW_DAYS) -> DataFrame:
    """request_id, variant, outcome, pre_period of every mature request."""
    requests = mature_requests(exposures, as_of, window_days).select("request_id", "variant")
    return (
        requests.join(outcomes(exposures, events, as_of, window_days), "request_id")
        .join(pre_period_counts(exposures, events, as_of, window_days), "request_id")
        .select("request_id", "variant", F.col("converted").cast("double").alias("outcome"), F.col("pre_period").cast("double").alias("pre_period"))
    )


def theta(rows: DataFrame) -> DataFrame:
    """One row: mature_requests, mean_x, theta = cov / var of the population, 0 where the covariate doesn't vary."""
    var = F.var_pop("pre_period")
    return rows.agg(
        F.count("*").alias("mature_requests"),
        F.avg("pre_period").alias("mean_x"),
        F.when(var > 0, F.covar_pop("outcome", "pre_period") / var).otherwise(0.0).alias("theta"),
    )


def variants(rows: DataFrame) -> DataFrame:
    """For each variant: requests, conversion_rate, cuped_conversion_rate, standard_error; with theta."""
    adjusted = F.col("outcome") - F.col("theta") * (F.col("pre_period") - F.col("mean_x"))
    both = rows.crossJoin(F.broadcast(theta(rows))).withColumn("adjusted", adjusted)  # one row of constants
    spread = F.sqrt(F.coalesce(F.when(F.count("*") > 1, F.var_samp("adjusted")), F.lit(0.0)) / F.count("*"))
    return both.groupBy("variant").agg(
        F.count("*").alias("requests"),
        F.avg("outcome").alias("conversion_rate"),
        F.avg("adjusted").alias("cuped_conversion_rate"),
        spread.alias("standard_error"),
        F.first("theta").alias("theta"),
    )


def comparison(by_variant: DataFrame) -> DataFrame:
    """One row: lifts, z score and guardrail of challenger against control; none unless both have requests."""
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    names = ("requests", "cuped_conversion_rate", "standard_error")
    row = by_variant.agg(*(pick(v, c).alias(f"{v}_{c}") for v in ("control", "challenger") for c in names)).filter("control_requests is not null and challenger_requests is not null")
    diff = F.col("challenger_cuped_conversion_rate") - F.col("control_cuped_conversion_rate")
    se = F.sqrt(F.col("control_standard_error") ** 2 + F.col("challenger_standard_error") ** 2)
    enough = F.least("control_requests", "challenger_requests") >= S.GUARDRAIL_N
    z = F.when(se > 0, diff / se).otherwise(0.0)
    return row.select(
        diff.alias("absolute_lift"),
        F.when(F.col("control_cuped_conversion_rate") != 0, diff / F.col("control_cuped_conversion_rate")).alias("relative_lift"),
        z.alias("z_score"),
        F.when(enough & (diff < 0) & (z <= S.GUARDRAIL_Z), "stop").otherwise("continue").alias("sequential_guardrail"),
        enough.alias("minimum_sample_reached"),
    )


def analyze(exposures: DataFrame, events: DataFrame, as_of: float, experiment: str = "ranker-v1", window_days: float = S.WINDOW_DAYS) -> dict:
    """The readout of an experiment as one report."""
    rows = observations(exposures.filter(F.col("experiment") == experiment), events, as_of, window_days).cache()
    try:
        n = rows.count()
        if not n:
            return {"experiment": experiment, "status": "insufficient_data", "mature_requests": 0}
        arms = variants(rows)
        found = {r.variant: r.asDict() for r in arms.collect()}
        verdict = comparison(arms).collect()
        names = ("requests", "conversion_rate", "cuped_conversion_rate", "standard_error")
        return {
            "experiment": experiment,
            "status": "ready",
            "mature_requests": n,
            "attribution_window_days": window_days,
            "cuped_theta": next(iter(found.values()))["theta"],
            "variants": {v: {k: found[v][k] for k in names} for v in sorted(found)},
            "comparison": verdict[0].asDict() if verdict else None,
        }
    finally:
        rows.unpersist()
