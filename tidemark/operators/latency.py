"""Serving metrics as aggregates, and their text form for scraping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas as S

PREFIX = "tidemark"


def histogram(rows: DataFrame, value: str = "latency_seconds", bounds=S.LATENCY_BUCKETS) -> DataFrame:
    """le, count: how many values are at or below each bound; the last bound is infinity."""
    every = [*bounds, float("inf")]
    counts = rows.agg(*(F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"c{i}") for i, b in enumerate(every)))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("count")) for i, b in enumerate(every)))
    return counts.select(F.explode(pairs).alias("x")).select("x.le", "x.count")


def nearest_rank(rows: DataFrame, value: str, shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """One row: mean, p50, p95, p99 (one for each share) and max. A percentile is the value at place round((n - 1) p),
    halves to even. Places come from counts of the distinct values, so no task sees all values."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    parts = 1024
    span = rows.agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    slot: Column = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1))).otherwise(0)
    from pyspark.sql import Window

    dealt = counts.join(F.broadcast(span)).withColumn("slot", slot)
    before = dealt.groupBy("slot").agg(F.sum("c").alias("s"))  # `parts` rows at most
    before = before.select("slot", (F.sum("s").over(Window.orderBy("slot")) - F.col("s")).alias("before"))
    own = Window.partitionBy("slot").orderBy("v")
    placed = dealt.withColumn("upto", F.sum("c").over(own)).join(F.broadcast(before), "slot").withColumn("last", F.col("before") + F.col("upto"))
    place = lambda p: F.bround((F.col("n") - 1) * F.lit(p)) + 1
    at = [F.max(F.when((F.col("last") >= place(p)) & (F.col("last") - F.col("c") < place(p)), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares]
    return placed.agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), *at, F.max("v").alias("max"))


def by_mode(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("mode").agg(F.count("*").alias("n"))


def by_reason(decisions: DataFrame) -> DataFrame:
    return decisions.filter("fallback_reason is not null").groupBy("fallback_reason").agg(F.count("*").alias("n"))


def render(modes: dict[str, int], reasons: dict[str, int], buckets: list[tuple[float, int]], total: float, prefix: str = PREFIX) -> str:
    """The metrics in the text format of Prometheus, labels sorted and escaped."""

    def escaped(text: str) -> str:
        return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")

    def block(name: str, kind: str, text: str) -> list[str]:
        return [f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} {kind}"]

    out = block("recommendation_requests_total", "counter", "Requests by serving mode.")
    out += [f'{prefix}_recommendation_requests_total{{mode="{escaped(m)}"}} {n}' for m, n in sorted(modes.items())]
    out += block("model_fallbacks_total", "counter", "Fallbacks by reason.")
    out += [f'{prefix}_model_fallbacks_total{{reason="{escaped(r)}"}} {n}' for r, n in sorted(reasons.items())]
    name = "recommendation_latency_seconds"
    out += block(name, "histogram", "Latency of requests.")
    out += [f'{prefix}_{name}_bucket{{le="{"+Inf" if le == float("inf") else le}"}} {n}' for le, n in buckets]
    count = buckets[-1][1] if buckets else 0
    return "\n".join([*out, f"{prefix}_{name}_sum {total}", f"{prefix}_{name}_count {count}"]) + "\n"
