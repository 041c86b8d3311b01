"""The grid of users and items: dealt to all tasks, worked out by lists of genres, and not built where ranks are asked for."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.events import half_up
from tidemark.ml import metrics, split as sp
from tidemark.operators import features as fe, ranking as rk, topk


@pytest.fixture(scope="module")
def town(spark):
    """Items that share genres, qualities and scores, with one without genres, and users who know some of them."""
    rng = random.Random(7)
    kinds = [["a", "b"], ["b", "a"], ["c"], ["a", "a"], [], ["b", "c", "d"]]
    items = spark.createDataFrame([(f"i{k:03d}", "t", kinds[rng.randrange(6)], rng.choice([0.2, 0.5, 0.8]), rng.choice([0.1, 0.79])) for k in range(150)], "item_id string, title string, genres array<string>, quality double, freshness double")
    roles = []
    for u in range(12):
        own = rng.sample(range(150), 8)
        roles += [(f"u{u}", f"i{x:03d}", float(k), "test" if k == 7 else "validation" if k == 6 else "train", 5.0) for k, x in enumerate(own)]
    return items.cache(), spark.createDataFrame(roles, "user_id string, item_id string, ts double, role string, cutoff double").cache()


def test_spread_deals_what_is_dealt_by_the_same_key(spark):
    """A join or an aggregate by the key before it had left all rows in one task."""
    counted = spark.range(400).groupBy("id").count()
    got = fe.spread(counted, "id").select(F.spark_partition_id().alias("p")).distinct().count()
    assert got == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_half_up_is_round(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-2, 2) for _ in range(3000)] + [k / 2**12 for k in range(-3000, 3000)] + [round(rng.random(), 9) + 5e-10 for _ in range(500)] + [0.0, -1e-12, 1e300, float("inf"), float("nan"), None, 12345.678901234567]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(half_up(F.col("x"), 9).alias("a"), F.round("x", 9).alias("b"))
    assert df.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0 and df.count() == len(xs)


def test_grid_is_score_of_all_candidates(spark, town):
    items, _ = town
    rows = [(f"r{k}", f"u{k}", float(k % 2), {"a": 0.1 * k, "d": -0.2}, [f"i{x:03d}" for x in range(k, k + 12)], k % 3, "challenger" if k % 2 else "control") for k in range(8)]
    known = spark.createDataFrame(rows, "request_id string, user_id string, as_of double, genre_affinity map<string,double>, recent_items array<string>, event_count long, variant string")
    plays = spark.createDataFrame([(t, f"i{k:03d}", k, 0.01 * k) for t in (0.0, 1.0) for k in range(1, 40, 3)], "as_of double, item_id string, plays long, popularity double")
    columns = ["request_id", "item_id", "plays", "retrieval_score", "rank_score"]
    want = rk.score(known.join(items, ~F.array_contains("recent_items", F.col("item_id"))), plays).withColumn("why", F.array_join(rk.reasons(), ";")).select(*columns, "why")
    each = F.array(*(F.array_join(rk.reasons(F.lit(f), F.lit(t)), ";") for f in (False, True) for t in (False, True)))
    got = rk.grid(known, items, plays, {"each": each}).withColumn("why", F.col("each")[F.when(F.col("freshness") > rk.FRESH, 2).otherwise(0) + F.when(F.col("plays") > rk.TRENDING, 1).otherwise(0)])
    assert sorted(map(tuple, got.select(*columns, "why").collect())) == sorted(map(tuple, want.collect()))
    assert {tuple(r) for r in rk.candidates(known, items).select("request_id", "item_id").collect()} == {(r[0], r[1]) for r in want.collect()}


def test_places_are_those_of_the_whole_grid(spark, town):
    items, split = town
    rows = sp.heuristic_scores(sp.evaluation_candidates(split, items), split, items).join(sp.train_popularity(split, items).select("item_id", "popularity"), "item_id")
    rows = metrics.stack(rows.withColumns({c: F.round(c, 9) for c in ("heuristic", "popularity")}), {"popularity": "popularity", "heuristic": "heuristic"})
    columns = ["model", "user_id", "item_id", "is_target", "rank"]
    want = {tuple(r) for r in metrics.ranked(rows).filter("is_target or rank <= 5").select(columns).collect()}
    assert {tuple(r) for r in sp.baseline_places(split, items).select(columns).collect()} == want
    for model in ("popularity", "heuristic"):
        assert {tuple(r) for r in sp.baseline_places(split, items, (model,)).select(columns).collect()} == {x for x in want if x[0] == model}


def test_popularity_sends_no_catalogue_to_users(spark, town):
    """Each lane of users had been sent the ids of all items in one group, which is one worker's memory."""
    items, split = town
    plan = sp.baseline_places(split, items, ("popularity",))._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Cartesian" not in plan


def test_shared_places(spark):
    """Ties, a user who knows the first ones, one who knows nothing, one who knows all, and a target that no item has."""
    scores = spark.createDataFrame([(f"i{k:02d}", [0.5, 0.1, 0.5][k % 3]) for k in range(30)], "item_id string, score double")
    users = spark.createDataFrame([("a", "i05", ["i00", "i02", "i09", "x"]), ("b", "i29", []), ("c", "gone", ["i00"]), ("d", "gone", [f"i{k:02d}" for k in range(30)])], "user_id string, target string, known array<string>")
    order = [r.item_id for r in scores.orderBy(F.desc("score"), "item_id").collect()]
    for k in (0, 5):
        want = set()
        for u, target, known in map(tuple, users.collect()):
            own = [x for x in order if x not in known]
            want |= {("m", u, x, x == target, n) for n, x in enumerate(own, 1) if n <= k or x == target}
        assert {tuple(r) for r in metrics.shared_places(users, scores, "m", k).collect()} == want


def test_approximate_search_lists_no_pairs(spark, monkeypatch):
    """The k best of all that share a bucket, found block by block: small blocks, so that buckets have several."""
    from pyspark.ml.feature import BucketedRandomProjectionLSHModel as Model

    rng = random.Random(5)
    items = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)], 0.1 * (k % 3)) for k in range(200)], "item_id long, v array<double>, bias double")
    queries = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(30)], "query_id long, q array<double>")
    hashed, transform, blocked = [], Model.transform, topk._blocked
    monkeypatch.setattr(Model, "transform", lambda self, df: hashed.append(transform(self, df)) or hashed[-1])
    monkeypatch.setattr(topk, "_blocked", lambda q, i, k, by=(): blocked(q, i, k, 16, 8, by))
    got = topk.approximate_top_k(queries, items, 10, tables=2)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    keys = [h.select(n, F.posexplode("hashes").alias("t", "h")) for h, n in zip(hashed, ("query_id", "item_id"), strict=True)]
    same = keys[0].join(keys[1], ["t", "h"]).select("query_id", "item_id").distinct()
    assert 0 < same.count() < 6000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, topk.exact_top_k(queries, items, 10, same).collect()))


def test_retrieval_meets_equal_vectors_once(spark, monkeypatch):
    items = spark.createDataFrame([(f"i{k:03d}", [float(k % 2), 1.0], 0.0) for k in range(120)], "item_id string, v array<double>, bias double")
    queries = spark.createDataFrame([(f"q{k}", [1.0, float(k % 2)]) for k in range(9)], "query_id string, q array<double>")
    out = spark.createDataFrame([("q0", ["i001", "i005", "i000"]), ("q1", [])], "query_id string, items array<string>")
    met, exact = [], topk.exact_top_k
    monkeypatch.setattr(topk, "exact_top_k", lambda q, i, k: met.append((q.count(), i.count())) or exact(q, i, k))
    got = {}
    for r in topk.top_k_without(queries, items, 4, out, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert met == [(2, 14)]
    assert got.pop("q0") == ["i003", "i007", "i009", "i011"]
    assert len(got) == 8 and all(x == ["i001", "i003", "i005", "i007"] for x in got.values())


def test_candidates_fold_up_on_disk(spark, town, tmp_path):
    """The rows are as many as users times items; a row had taken some five bytes in a file."""
    items = spark.range(20_000).select(F.format_string("i%09d", "id").alias("item_id"))
    roles = [(f"u{u:07d}", f"i{(7 * u + k) % 90:09d}", float(k), "test" if k == 7 else "validation" if k == 6 else "train", 5.0) for u in range(200) for k in range(8)]
    split = spark.createDataFrame(roles, "user_id string, item_id string, ts double, role string, cutoff double")
    sp.evaluation_candidates(split, items).write.parquet(f"{tmp_path}/rows")
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 1_500_000
    got = spark.read.parquet(f"{tmp_path}/rows")
    assert got.count() == got.distinct().count() == 200 * (20_000 - 7)
    assert got.filter("is_target").count() == 200


@pytest.mark.parametrize(("target", "users"), [("test", 40_000), ("validation", 40_000), ("test", 5)])
def test_candidates_are_all_items_but_the_known_ones(spark, town, monkeypatch, target, users):
    items, split = town
    monkeypatch.setattr(sp, "USERS", users)
    own, out = [r.item_id for r in items.collect()], {}
    for r in split.collect():
        out.setdefault(r.user_id, {})[r.item_id] = r.role
    want = sorted((u, i, roles.get(i) == target) for u, roles in out.items() for i in own if roles.get(i) not in {"test": ("train", "validation"), "validation": ("train",)}[target])
    assert sorted(map(tuple, sp.evaluation_candidates(split, items, target).collect())) == want


FOLDS = {
    "candidates_anti_consumed": (["request_id", "item_id"], "true", 150_000, 30, 0.5),
    "cold_start_scores": (["request_id", "item_id", "retrieval_score"], "event_count = 0", 12_000, 300, 0.35),
    "heuristic_scores_challenger": (["request_id", "item_id", "plays", "retrieval_score", "rank_score"], "variant = 'challenger'", 12_000, 300, 0.9),
    "heuristic_scores_control": (["request_id", "item_id", "plays", "retrieval_score", "rank_score"], "variant = 'control'", 12_000, 300, 0.6),
    "reasons": (["request_id", "item_id", "reasons"], "true", 12_000, 300, 0.25),
}


@pytest.mark.parametrize("name", FOLDS)
def test_grid_folds_up_on_disk(spark, tmp_path, name):
    """Rows as many as requests times items: chunks of items meet the requests, so that a file's columns recur."""
    columns, only, items_n, requests_n, most = FOLDS[name]
    words = "abcdefgh"
    items = spark.createDataFrame([(f"i{k:09d}", [words[k % 8], words[k // 8 % 8]], (k * 7 % 3) / 4, (k * 37 % 4) / 4) for k in range(items_n)], "item_id string, genres array<string>, quality double, freshness double")
    rows = [(f"u{k:07d}@{k % 2}", float(k % 2), {w: ((k * 31 + n * 17) % 1009) / 1009 for n, w in enumerate(words)}, [f"i{x:09d}" for x in range(k, k + 12)], k % 3, "challenger" if k // 2 % 2 else "control") for k in range(requests_n)]
    known = spark.createDataFrame(rows, "request_id string, as_of double, genre_affinity map<string,double>, recent_items array<string>, event_count long, variant string").filter(only)
    plays = spark.createDataFrame([(t, f"i{k:09d}", k, 0.01 * k) for t in (0.0, 1.0) for k in range(1, 90, 3)], "as_of double, item_id string, plays long, popularity double")
    each = F.array(*(F.array_join(rk.reasons(F.lit(f), F.lit(t)), ";") for f in (False, True) for t in (False, True)))
    if name == "candidates_anti_consumed":
        got = rk.candidates(known, items.select("item_id"))
    else:
        got = rk.grid(known, items, plays, {"each": each}).withColumn("reasons", F.col("each")[F.when(F.col("freshness") > rk.FRESH, 2).otherwise(0) + F.when(F.col("plays") > rk.TRENDING, 1).otherwise(0)])
    # A catalogue that is sent to all tasks passes through the driver's memory, and puts all items beside one request.
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    got.select(columns).write.parquet(f"{tmp_path}/rows")
    size = sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet"))
    got = spark.read.parquet(f"{tmp_path}/rows")
    n = known.count() * (items_n - 12)
    assert got.count() == got.select("request_id", "item_id").distinct().count() == n
    assert size < n * most
