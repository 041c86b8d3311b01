import math
import random

import numpy as np

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, every=50):
    """The results of every query row, as a list."""
    fit = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, v in fit:
        if q is not None and q % every == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i is None, i or 0) for m, i, w in fit if m != n and len(w) == len(v))[:k]
            out += [(q, r + 1, None if lost else i, -s) for r, (s, lost, i) in enumerate(found)]
    return sorted(map(str, out))


def check(spark, rows):
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as rank", "3 as row", "4 as dim").repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 100)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "STEP", 4)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) / 4).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2050, [float("nan")] * 12), (2100, [None] * 12), (None, rows[0][1]), (2150, [1.0, 2.0]), (2151, [1.0, 2.0]), (2200, [0.0] * 12), (-50, [-0.5] * 12)]
    check(spark, rows)


def test_repeated_ids_and_rows(spark):
    """Each query row has its own result, and only its own row is left out."""
    rows = [(50, [0.5, 0.5]), (50, [0.5, 0.5]), (50, [0.1, -0.9]), (1, [0.2, 0.2]), (1, [0.2, 0.2]), (None, [0.5, 0.5]), (None, [0.9, 0.9]), (2, [0.4, -0.4])]
    check(spark, rows)
    check(spark, rows * 7)
    check(spark, [(100, [0.5])] * 9)


def test_few_rows(spark):
    check(spark, [(0, [0.5, 0.5]), (1, [0.1, -0.2]), (50, [0.3, 0.3])])
    check(spark, [(0, [0.5, 0.5])])
    check(spark, [(0, []), (1, [])])
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_components(spark):
    check(spark, [(0, [1e12, 2e12]), (1, [3e11, -1e12]), (2, [1e30, -1e30]), (50, [1.0, 1.0])])
    rng = random.Random(4)
    check(spark, [(i, [rng.choice([1, 1e3, 1e7]) * rng.uniform(-1, 1) * 2.0**24 for _ in range(6)]) for i in range(300)])


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v, q = rng.integers(-256, 256, (500, 9)).astype(float), rng.integers(-256, 256, (20, 9)).astype(float)
    bounds = topk.Bounds(*topk.quantise(v))
    assert (bounds.upper(q) >= q @ v.T).all() and (bounds.lower(q) <= q @ v.T).all()


def test_many_equal_and_many_near_vectors(spark):
    """Copies share one bound: no row may come twice, and the smallest ids must come. Near copies crowd the top."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 8)) / 4
    v[:1000] = 0.9
    v[1000:2000] = 0.9 + 0.001 * rng.normal(size=(1000, 8))
    ids = rng.permutation(3000)
    whole = np.floor(256 * v)
    want = []
    for n in np.flatnonzero(ids % 50 == 0):
        score = whole @ whole[n]
        order = [m for m in np.lexsort((ids, -score)) if m != n][:5]
        want += [(int(ids[n]), r + 1, int(ids[m]), int(score[m])) for r, m in enumerate(order)]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], SCHEMA).repartition(6)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
