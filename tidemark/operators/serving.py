"""Who is served by the model, who by the heuristic, and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Loaded:
    """A model as serving sees it: its version, its users and its items."""

    version: str
    users: DataFrame
    items: DataFrame


def same_catalogue(model_items: DataFrame, items: DataFrame) -> bool:
    """Whether both have the same item_ids."""
    a, b = (df.select("item_id").distinct() for df in (model_items, items))
    return a.join(b, "item_id", "left_anti").isEmpty() and b.join(a, "item_id", "left_anti").isEmpty()


def decide(requests: DataFrame, model: Loaded | None, items: DataFrame, error: str | None = None) -> DataFrame:
    """requests (with variant) with mode, model_version and fallback_reason.

    Only challengers reach the model; without one, with a user it doesn't know, or with another catalogue than the one
    it was trained on, they fall back to the heuristic, ranked by the challenger's weights.
    """
    if model is None:
        mode = F.when(F.col("variant") != "challenger", "heuristic_control").otherwise("heuristic_fallback")
        why = F.when(F.col("variant") == "challenger", F.lit(error or "no model configured"))
        return requests.withColumns({"mode": mode, "model_version": F.lit(None).cast("string"), "fallback_reason": why})
    same = F.lit(same_catalogue(model.items, items))
    rows = requests.join(model.users.select("user_id").distinct().withColumn("_known", F.lit(True)), "user_id", "left")
    why = F.when(F.col("variant") != "challenger", None).when(F.col("_known").isNull(), "unknown user").when(~same, "catalog mismatch")
    mode = F.when(F.col("variant") != "challenger", "heuristic_control").when(why.isNotNull(), "heuristic_fallback").otherwise("learned_challenger")
    return rows.withColumns({"mode": mode, "model_version": F.lit(model.version), "fallback_reason": why}).drop("_known")


def ladder(variant: str, version: str | None, error: str | None, known: bool, same: bool) -> tuple[str, str | None, str | None]:
    """decide for one request on the driver: mode, model version and reason."""
    if variant != "challenger":
        return "heuristic_control", version, None
    if version is None:
        return "heuristic_fallback", None, error or "no model configured"
    if not known:
        return "heuristic_fallback", version, "unknown user"
    return ("learned_challenger", version, None) if same else ("heuristic_fallback", version, "catalog mismatch")
