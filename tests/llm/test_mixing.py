import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def want_targets(sizes):
    """By many small shares instead of solving for the caps."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, lo, hi = sum(sizes.values()), 0.0, 1e15
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(3 * sizes[s], mid * weight[s]) for s in sizes) < total:
            lo = mid
        else:
            hi = mid
    return {s: min(3 * sizes[s], hi * weight[s]) for s in sizes}


def docs(seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "a", "b", "Z", "é", None, "tiny"] if i % 9 == 0 else ["a", "a", "b", "é"])) for i in range(n)]
    return rows + [(1000, None, "a"), (1001, "", "b"), (None, "x y z", "b"), (5, "repeated words", "a"), (5, "repeated words", "a"), (1002, "z " * 50_000, "é"), (1003, None, "empty")]


def test_mix(spark):
    rows = docs()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as pattern").repartition(5)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    sizes, source_of = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
        source_of[i, size(t)] = s
    goal = want_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-3
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max([size(t) for _, t, x in rows if x == s]) + 1, s


def test_many_rows_alike(spark, monkeypatch):
    """Rows without id, or all alike, are as many documents, and no window sees them one by one."""
    rows = [(None, "w w", "a")] * 300 + [(None, f"w{i} x", "a") for i in range(300)] + [(7, "y", "b")] * 100
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in got)
    goal = want_targets({"a": 1200, "b": 100})
    for s, ids in (("a", {None}), ("b", {7})):
        assert abs(sum(r.taken for r in got if r.doc_id in ids) - goal[s]) <= 3
    monkeypatch.setattr(mixing, "PATTERNS", 1)
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix_sources(spark.createDataFrame(rows, SCHEMA))


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def cost(supply, flow):
    """Of the cheapest way to bring forth what the flow takes of each pattern."""
    out = 0
    for p, n in supply.items():
        used = sum(x for (q, _), x in flow.items() if q == p)
        for k in range(3):
            out += k * k * max(0, min(n, used - k * n))
    return out


def test_flow_is_the_cheapest():
    """Against all flows of small integer problems."""
    rng = random.Random(4)
    for _ in range(60):
        patterns = rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)
        supply = {p: rng.randrange(1, 3) for p in patterns}
        quota = {s: rng.randrange(0, 5) for s in "abc"}
        edges = [(p, s) for p in patterns for s in p]
        best = None
        for amounts in itertools.product(*(range(min(quota[s], 3 * supply[p]) + 1) for p, s in edges)):
            flow = dict(zip(edges, amounts))
            if all(sum(x for (q, _), x in flow.items() if q == p) <= 3 * supply[p] for p in patterns) and all(sum(x for (_, t), x in flow.items() if t == s) <= quota[s] for s in quota):
                key = (-sum(amounts), cost(supply, flow))
                best = min(best or key, key)
        got = mixing.min_cost_flow(supply, quota)
        assert (-sum(got.values()), cost(supply, got)) == best
        for s in quota:
            assert sum(x for (_, t), x in got.items() if t == s) <= quota[s]


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(100)], "doc_id long, m array<string>, n long")
    got = mixing.mix(df, F.col("m"), F.col("n"), weights=lambda i: 1, total=1000).collect()
    by = {"0a": 0, "0b": 0}
    for r in got:
        assert set(r.copies) <= set(r.pattern) and r.taken == 10 * sum(r.copies.values())
        for s, n in r.copies.items():
            by[s] += n * 10
    assert by == {"0a": 500, "0b": 500}
