"""A record of training runs: a JSON file for each run, and MLflow where it is installed."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.sources import files


def flat_metrics(report: dict) -> dict[str, float]:
    """Every metric of every model under one name, with the figures of training."""
    out = {f"{model}_{name}": value for model, values in report["metrics"].items() for name, value in values.items()}
    return out | {k: v for k, v in report["training"].items() if isinstance(v, (int, float))}


def track(spark: SparkSession, root: str, report: dict, artifact: str | None = None, uri: str | None = None, experiment: str = "ranking") -> dict:
    """Write the run below `root` and, given a uri and MLflow, there too. Returns the record."""
    record = {
        "run": f"ranker-{report['model_version']}",
        "parameters": report["configuration"] | {f"split_{k}": v for k, v in report["split"].items()},
        "metrics": flat_metrics(report),
        "tags": {"model_version": report["model_version"], "task": "implicit-feedback-ranking"},
        "artifact": artifact,
    }
    files.write_json(spark, f"{root.rstrip('/')}/{record['run']}.json", record)
    if uri:
        try:
            import mlflow
        except ImportError:
            return record
        mlflow.set_tracking_uri(uri)
        mlflow.set_experiment(experiment)
        with mlflow.start_run(run_name=record["run"]):
            mlflow.log_params(record["parameters"])
            mlflow.log_metrics(record["metrics"])
            mlflow.set_tags(record["tags"])
    return record
