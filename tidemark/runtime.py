"""A loaded model behind the recommender: fail-safe loading, decisions, learned candidates and slates."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas as S
from tidemark.ml.training import Bundle
from tidemark.operators import experiments as ex, features as fe, ranking as rk, serving, topk

#: Learned candidates for a slate: four for each place, and twenty at least.
LEAST_CANDIDATES, PER_PLACE = 20, 4


class Runtime:
    def __init__(self, bundle: Bundle | None = None, source: str | None = None, error: str | None = None):
        self.bundle, self.source, self.error = bundle, source, error

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Runtime:
        """The model at a path; what is missing or unreadable gives a runtime that isn't ready, and says why."""
        try:
            return cls(Bundle.load(spark, path), path)
        except Exception as e:  # whatever is wrong with the artifact, requests are served without it
            return cls(None, path, str(e).splitlines()[0])

    @property
    def version(self) -> str | None:
        return self.bundle.version if self.bundle else None

    def status(self) -> dict:
        if self.bundle is None:
            return {"ready": False, "model_version": None, "source": self.source, "error": self.error or "no model configured"}
        return {"ready": True, "model_version": self.version, "source": self.source, "users": self.bundle.users.count(), "items": self.bundle.items.count(), "retrieval_engine": "exact"}

    def loaded(self) -> serving.Loaded | None:
        return serving.Loaded(self.bundle.version, self.bundle.users, self.bundle.items) if self.bundle else None

    def retrieve(self, known: DataFrame, items: DataFrame, k: int) -> DataFrame:
        """request_id, item_id of the k items of the catalogue that the towers put first for each request, without its
        recent ones; known has request_id, user_id and recent_items."""
        users = self.bundle.users.select("user_id", F.col("vector").alias("q"))
        queries = known.select(F.col("request_id").alias("query_id"), "user_id").join(users, "user_id").select("query_id", "q")
        own = self.bundle.items.join(items.select("item_id"), "item_id", "left_semi").select("item_id", F.col("vector").alias("v"), "bias")
        recent = known.select(F.col("request_id").alias("query_id"), F.array_distinct("recent_items").alias("items"))
        return topk.top_k_without(queries, own, k, recent, S.RECENT).select(F.col("query_id").alias("request_id"), "item_id")

    def recommend(self, requests: DataFrame, events: DataFrame, items: DataFrame, k: int = S.SLATE, salt: str = ex.SALT, experiment: str = "ranker-v1") -> tuple[DataFrame, DataFrame]:
        """(slates, decisions) of all requests: learned where the model serves, by the heuristic elsewhere."""
        arms = requests.withColumns(ex.assign(F.col("user_id"), experiment, salt))
        decisions = serving.decide(arms, self.loaded(), items, self.error)
        learned = None
        if self.bundle:
            served = decisions.filter("mode = 'learned_challenger'").select("request_id", "user_id", "as_of")
            known = fe.user_features(served, events, items)
            some = self.retrieve(known, items, max(LEAST_CANDIDATES, PER_PLACE * k)).join(served.select("request_id", "user_id"), "request_id")
            learned = self.bundle.scores(some)
        slates = rk.recommend(requests, events, items, k, salt, experiment, learned)
        kept = decisions.select("request_id", "mode", F.col("model_version"), "fallback_reason")
        return slates.drop("serving_mode").join(kept, "request_id").withColumnRenamed("mode", "serving_mode"), kept


def benchmark(runtime: Runtime, requests: DataFrame, events: DataFrame, items: DataFrame) -> dict:
    """Slates per second of one batch of requests."""
    began = time.perf_counter()
    slates, _ = runtime.recommend(requests, events, items)
    rows = slates.select("request_id", "serving_mode").distinct().groupBy("serving_mode").agg(F.count("*").alias("n")).collect()
    took = time.perf_counter() - began
    n = sum(r.n for r in rows)
    return {"requests": n, "seconds": took, "slates_per_second": n / took, "serving_modes": {r.serving_mode: r.n for r in rows}}
