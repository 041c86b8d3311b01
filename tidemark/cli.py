"""The command line: data, lake, training, registry, readouts, benchmarks and the HTTP front."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession, functions as F

from tidemark import demo, session
from tidemark.operators import drift, experiments as ex, topk
from tidemark.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description="Behavioural event analytics on Spark")
    top.add_argument("--store", default="data/store", help="folder of items, events and exposures")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, **options):
        c = commands.add_parser(name, help=text)
        for key, value in options.items():
            flag = "--" + key.replace("_", "-")
            c.add_argument(flag, required=True) if value is None else c.add_argument(flag, action="store_true") if value is False else c.add_argument(flag, type=type(value), default=value)

    lake = {"lake": "data/lake", "watermark_minutes": 10.0}
    add("demo", "seed the demonstration")
    add("serve", "run the HTTP front", port=8787, model="artifacts/model", registry="", no_model=False)
    add("pipeline", "process logged events into the lake", batch_size=1000, **lake)
    add("repair-late", "move quarantined events into silver", **lake)
    add("verify-pipeline", "replay silver and compare with gold", **lake)
    add("ml-demo", "seed a population to train on", users=240)
    add("train", "train and evaluate the models", output="artifacts/model", dimensions=16, epochs=35, seed=17, tracking_uri="", no_track=False)
    add("benchmark-serving", "slates per second of a batch", model="artifacts/model", requests=1000)
    add("benchmark-ann", "recall and time of approximate retrieval", items=100_000, queries=100, dimensions=64, neighbors=50, seed=17)
    add("analyze-experiment", "the readout of an experiment", experiment="ranker-v1", window_days=7.0)
    add("register-model", "stage a model behind its gates", model="artifacts/model", registry="artifacts/registry")
    add("promote-model", "make a staged model the champion", version=None, registry="artifacts/registry")
    add("rollback-model", "return to the champion before", registry="artifacts/registry")
    add("registry-status", "show the registry", registry="artifacts/registry")
    add("detect-drift", "compare live traffic with training", model="artifacts/model", warning_threshold=0.10)
    return top


def benchmark_ann(spark: SparkSession, items: int, queries: int, dimensions: int, neighbors: int, seed: int) -> dict:
    """Exact blocks against hashing on random unit vectors."""

    def vectors(n: int, name: str, column: str, salt: int):
        raw = F.array(*(F.randn(seed * 1000 + salt + i) for i in range(dimensions)))
        rows = spark.range(n).select(F.col("id").alias(name), raw.alias("x"))
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y * y))
        return rows.select(name, F.transform("x", lambda y: y / norm).alias(column)).cache()

    own = vectors(items, "item_id", "v", 0).withColumn("bias", F.lit(0.0))
    asked = vectors(queries, "query_id", "q", 500)
    out: dict = {"workload": {"items": items, "queries": queries, "dimensions": dimensions, "neighbors": neighbors, "seed": seed}}
    found = {}
    own.count(), asked.count()
    for name, f in (("exact", topk.exact_top_k), ("approximate", topk.approximate_top_k)):
        began = time.perf_counter()
        found[name] = f(asked, own, neighbors).cache()
        found[name].count()
        out[f"{name}_ms_per_query"] = (time.perf_counter() - began) * 1000 / queries
    return out | {"recall_at_k": topk.recall(found["approximate"], found["exact"], neighbors).first().recall}


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    from tidemark import api, runtime
    from tidemark.ml import tracking, training
    from tidemark.registry import Registry
    from tidemark.streaming.medallion import Medallion

    store = Store(spark, args.store)
    if args.command == "demo":
        return demo.seed(store)
    if args.command == "ml-demo":
        return {"users": args.users} | demo.seed(store, users=args.users)
    if args.command in ("pipeline", "repair-late", "verify-pipeline"):
        lake = Medallion(spark, args.lake, store.items(), args.watermark_minutes * 60)
        return lake.run_all(store.log(), args.batch_size) if args.command == "pipeline" else lake.repair_late() if args.command == "repair-late" else lake.verify()
    if args.command == "train":
        report = training.train(store.events(), store.items(), args.dimensions, args.epochs, args.seed, args.output).report
        if not args.no_track:
            tracking.track(spark, f"{args.store}/runs", report, args.output, args.tracking_uri or None)
        return report
    if args.command == "analyze-experiment":
        return ex.analyze(store.exposures(), store.events(), time.time(), args.experiment, args.window_days)
    if args.command == "benchmark-ann":
        return benchmark_ann(spark, args.items, args.queries, args.dimensions, args.neighbors, args.seed)
    if args.command == "benchmark-serving":
        model = runtime.Runtime.load(spark, args.model)
        users = store.events().select("user_id").distinct()
        copies = F.explode(F.sequence(F.lit(1), F.lit(max(1, -(-args.requests // max(1, users.count()))))))
        asked = users.withColumn("n", copies).orderBy("n", "user_id").limit(args.requests).select(F.concat_ws("#", "user_id", "n").alias("request_id"), "user_id", F.lit(time.time()).alias("as_of"))
        return runtime.benchmark(model, asked, store.events(), store.items()) | {"model_version": model.version}
    if args.command == "detect-drift":
        bundle = training.Bundle.load(spark, args.model)
        return drift.detect(store.events(), bundle.items, args.warning_threshold, bundle.version)
    if args.command == "serve":
        path = Registry(spark, args.registry).active_path() if args.registry else args.model
        if args.registry and path is None:
            raise SystemExit("the registry has no promoted model")
        # No artifact at all means no model; a broken one is a model that falls back.
        from tidemark.sources import files

        model = runtime.Runtime.load(spark, path) if not args.no_model and files.exists(spark, f"{path}/manifest.json") else None
        web = api.server(api.Service(store, model), port=args.port)
        print(f"serving on http://127.0.0.1:{args.port}", flush=True)
        try:
            web.serve_forever()
        finally:
            web.server_close()
        return {}
    registry = Registry(spark, args.registry)
    if args.command == "register-model":
        return registry.register(args.model)
    if args.command == "promote-model":
        return registry.promote(args.version)
    return registry.rollback() if args.command == "rollback-model" else registry.status()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    result = run(args, spark or session.build())
    print(json.dumps(result, indent=2, sort_keys=True, default=str))
    return result


if __name__ == "__main__":
    main()
