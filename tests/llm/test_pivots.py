import math

import numpy as np

from tidemark.llm import common, pivots


def brute(rows):
    def fit(r):
        return r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    unit = [(lambda v: v / np.linalg.norm(v))(np.array(r[1]) / np.abs(r[1]).max()) if fit(r) else None for r in rows]
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98] for i in range(n)]
    group = list(range(n))
    for i in range(n):
        for j in near[i]:
            if group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for i, r in enumerate(rows):
        least = min((rows[k][0] for k in range(n) if group[k] == group[i] and rows[k][0] is not None), default=None)
        out.append((r[0], len(near[i]), least, r[0] is not None and r[0] == least))
    return out


def data(n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=d).astype("f4").astype(float)
        if rows and rng.random() < 0.5:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = (base + rng.choice([0, 0.03, 0.1]) * rng.normal(size=d)).astype("f4").astype(float)
        rows.append((int(7 * i % 1000), v.tolist(), int(rng.integers(2))))
    v = rows[0][1]
    rows += [(2000, None, 0), (2001, [0.0] * d, 0), (2002, v, None), (2003, [*v[1:], None], 0), (2004, [*v[1:], float("nan")], 0), (2005, [*v[1:], float("inf")], 0), (2006, v, rows[0][2]), (2006, v, rows[0][2]), (None, v, rows[0][2]), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (2009, [], 0), (2010, [1e200, 2e200], 0)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_links(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pivots, "LIST", 20)
    monkeypatch.setattr(common, "GROUP", 2)
    rows = data()
    got = pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as copies", "2 as u").repartition(3)).collect()
    assert sorted((str(tuple(r)) for r in got)) == sorted(str(r) for r in brute(rows))


def test_sketches_lose_few():
    """Vectors at the very cosine looked for: nearly all are within reach of each other, and unrelated ones are not."""
    rng = np.random.default_rng(6)
    planes = rng.normal(size=(64, pivots.SIGNS))
    u, w = rng.normal(size=(2, 20_000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    far = lambda x, y: ((x @ planes > 0) != (y @ planes > 0)).sum(1)
    reach = pivots.reach(0.98)
    assert (far(u, 0.98 * u + math.sqrt(1 - 0.98**2) * w) <= reach).mean() > 0.999
    assert (far(u, w) <= reach).mean() == 0 and pivots.reach(1.0) == 0


def test_recall_against_brute_force(spark):
    """Bunches of near copies from two to hundreds among unrelated vectors, at production parameters."""
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(120):
        base = rng.normal(size=64)
        for _ in range(int(rng.choice([1, 1, 2, 5, 20, 150], p=[0.3, 0.3, 0.2, 0.1, 0.07, 0.03]))):
            rows.append((len(rows), (base + rng.choice([0.0, 0.05, 0.12, 0.14]) * rng.normal(size=64)).tolist(), int(rng.integers(2))))
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    n = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])).sum(1) - 1
    exact = spark.createDataFrame([(r[0], int(k)) for r, k in zip(rows, n)], "vec_id long, n_links long")
    found = pivots.near_duplicates(spark.createDataFrame(rows, SCHEMA)).cache()
    assert n.sum() > 500
    assert pivots.recall(found, exact) >= 0.99
    assert found.join(exact.withColumnRenamed("n_links", "m"), "vec_id").filter("n_links > m").count() == 0


def test_recall_in_a_dense_group(spark):
    """Half of the rows are near copies of one vector, not exact ones; they must not be each other's pivots."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 64))
    v[::2] = v[0] + 0.13 * rng.normal(size=(3000, 64))
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA).cache()
    chosen = np.array(pivots.choose_pivots(df.selectExpr("embedding as vector"), len(v)))
    chosen /= np.linalg.norm(chosen, axis=1, keepdims=True)
    assert len(chosen) == int(len(v) ** 0.5)
    assert (chosen @ chosen.T - 2 * np.eye(len(chosen))).max() < pivots.APART
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    n = (unit @ unit.T >= 0.98).sum(1) - 1
    exact = spark.createDataFrame([(i, int(k)) for i, k in enumerate(n)], "vec_id long, n_links long")
    assert n.sum() > 1_000_000
    assert pivots.recall(pivots.near_duplicates(df), exact) >= 0.999


def test_empty(spark):
    assert pivots.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(pivots.near_duplicates(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect()) == 1
