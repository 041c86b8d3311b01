import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import common


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "chain": [(k, k + 1) if k % 3 else (k + 1, k) for k in range(40)],
        "star": [(99, k) for k in range(30)] + [(99, 99)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "none": [(5, 5)],
    }[kind]
    got = common.components(spark.createDataFrame(edges + edges[:3], "u long, v long")).collect()
    assert {r.node: r.root for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_star_links():
    i, j = np.array([0, 2, 5, 5]), np.array([1, 1, 6, 5])
    place, root = common.star_links(i, j, 8)
    assert dict(zip(place.tolist(), root.tolist())) == {1: 0, 2: 0, 6: 5}


def test_pieces():
    texts = ["a" * 10, None, "", "b" * 50, "c", "d" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(6))], names=["t", "n"])
    for size in (1, 5, 11, 1000):
        cut = list(common.pieces(iter([batch, batch.slice(0, 0)]), "t", size))
        assert [x for b in cut for x in b.column("t").to_pylist()] == texts
        assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column("t").to_pylist()) <= size for b in cut)
