import itertools
import random
import zlib

import numpy as np

from tidemark.llm import crf


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 5, 2, 0]
    starts = np.append(0, np.cumsum(sizes))
    node, edge = rng.normal(size=starts[-1]), rng.normal(size=(2, 2))
    got, count = crf.marginals(node, edge, starts)
    want, pairs = np.zeros(len(node)), np.zeros((2, 2))
    for i, n in zip(starts, sizes):
        if not n:
            continue
        weights = {}
        for y in itertools.product((0, 1), repeat=n):
            weights[y] = np.exp(sum(node[i + k] for k in range(n) if y[k]) + sum(edge[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        for y, w in weights.items():
            for k in range(n):
                want[i + k] += w / total * y[k]
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w / total
    assert np.allclose(got, want) and np.allclose(count, pairs)


def slow_marginals(node, edge, starts):
    """Forward and backward, line by line."""
    out = np.zeros(len(node))
    for i, j in zip(starts, starts[1:]):
        ahead, back = np.zeros((j - i, 2)), np.zeros((j - i, 2))
        for k in range(j - i):
            ahead[k] = [0, node[i + k]]
            if k:
                ahead[k] += np.logaddexp.reduce(ahead[k - 1][:, None] + edge, axis=0)
        for k in range(j - i - 2, -1, -1):
            back[k] = np.logaddexp.reduce(edge + [0, node[i + k + 1]] + back[k + 1], axis=1)
        odds = (ahead + back) @ [-1, 1]
        out[i:j] = 1 / (1 + np.exp(-odds))
    return out


def test_marginals_of_long_chains(monkeypatch):
    rng = np.random.default_rng(4)
    for segment, sizes in ((512, [3, 2000, 0, 512, 513, 1]), (4, [1, 4, 5, 8, 9, 37, 0]), (1, [3, 1, 7])):
        monkeypatch.setattr(crf, "SEGMENT", segment)
        starts = np.append(0, np.cumsum(sizes))
        node, edge = 2 * rng.normal(size=starts[-1]), rng.normal(size=(2, 2))
        bad, count = crf.marginals(node, edge, starts)
        assert np.allclose(bad, slow_marginals(node, edge, starts))
        assert np.isclose(count.sum(), sum(max(0, n - 1) for n in sizes))


def test_nodes_are_the_potentials_of_the_features(monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["a b\nC D!!\n\n x | y", None, "one", "\n".join(f"line {i} " * (i % 4 + 1) for i in range(300)), "", "z\nz"]
    x, size, starts = crf.features(texts)
    for cut, together in ((1 << 20, 1 << 16), (50, 7)):
        monkeypatch.setattr(crf, "CUT", cut)
        monkeypatch.setattr(crf, "TOGETHER", together)
        model = crf.Model(rng.normal(size=crf.FEATURES), 1 + rng.random(crf.FEATURES), rng.normal(size=crf.FEATURES), np.zeros((2, 2)), (0, 0), 0.5)
        node, sizes, at = model.nodes(texts)
        assert at.tolist() == starts.tolist() and sizes.tolist() == size.tolist()
        assert np.allclose(node, np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights, atol=1e-4)


def test_runs_are_of_neighbours():
    assert crf.runs(0) == [] and crf.runs(5) == [(0, 5)] and crf.runs(400) == [(0, 400)]
    found = crf.runs(10_000)
    assert found[0][0] == 0 and found[-1][1] == 10_000 and sum(j - i for i, j in found) == crf.LINES and len(found) == crf.RUNS
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_transitions_of_long_documents(spark):
    """Runs of a long document's lines teach the same chain as all of its lines do."""
    good, bad = "the river and the stone of light", "### $$$ @@@ ###"
    rows = [(i, "\n".join(([good] * 9 + [bad] * 9 * (i % 2)) * 100)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    some, whole = crf.train(docs, labels), crf.train(docs, labels, lines=10**6)
    tie = lambda m: m.transitions[0, 0] + m.transitions[1, 1] - m.transitions[0, 1] - m.transitions[1, 0]  # the rest is a shift
    assert abs(tie(some) - tie(whole)) < 0.25 and tie(some) > 1
    assert {r.doc_id: r.predicted for r in crf.classify(docs, labels).collect()} == {i: 1 - i % 2 for i in range(40)}


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    seen = []
    real = crf.fit
    monkeypatch.setattr(crf, "fit", lambda x, size, starts, quality, owner: seen.append((len(x), len(quality))) or real(x, size, starts, quality, owner))
    rows = [(i % 3, f"text {i}\nof lines\n" * 30) for i in range(300)]
    crf.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int"), lines=20)
    assert seen[0][1] <= 3 and seen[0][0] <= 60


def test_very_many_lines():
    """A long text of tiny lines: memory and time stay within bounds."""
    import resource
    import time

    model = crf.Model(np.zeros(crf.FEATURES), np.ones(crf.FEATURES), np.full(crf.FEATURES, 0.01), np.array([[0.5, -0.5], [-0.5, 0.5]]), (0.0, -1.0), 0.5)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    assert 0 < model.scores(["x\n" * 2_000_000])[0] < 1
    assert time.perf_counter() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kB


def test_features_of_lines():
    x, size, starts = crf.features(["One line here\n\n  \nTWO!!", None, "", "a | b | c"])
    assert starts.tolist() == [0, 2, 2, 2, 3] and size.tolist() == [13, 5, 9]
    assert np.allclose(x[1, 1], 3 / 4) and np.allclose(x[1, 4], 2 / 5) and np.allclose(x[2, 3], 2 / 9)
    assert np.allclose(x[0, 2 * crf.OWN : 3 * crf.OWN], x[1, : crf.OWN]) and np.allclose(x[1, crf.OWN : 2 * crf.OWN], x[0, : crf.OWN])


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "river", "stone", "walks", "and", "light", "Morning,", "slowly."]
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randrange(3, 30))) for _ in range(rng.randrange(1, 8))]
        good = rng.random() < 0.8
        if not good:
            k = rng.randrange(len(lines))
            for j in range(k, len(lines)):
                lines[j] = " ".join(w + "###" for w in lines[j].split()) if i % 2 else lines[j].upper().replace(" ", "!! ")
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return docs, labels


def test_query(spark):
    docs, labels = corpus()
    rows = docs + [(5000, None), (5001, ""), (5002, " \n "), (None, "the river"), (5003, "\n".join(t for (_, t), (_, q) in zip(docs * 20, labels * 20) if q)), (7, docs[7][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as quality").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int").selectExpr("*", "'x' as text")
    got = crf.classify(frame, known).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        by[r.doc_id] = r
    truth = dict(labels)
    held = [r for i, r in by.items() if r.held_out and i in truth]
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert by[5000].score == by[5001].score == by[5002].score and by[5003].predicted == 1
    again = {r.doc_id: r.score for r in crf.classify(frame.repartition(5), known).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in by.items())


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(200)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a = {r.doc_id: r.score for r in crf.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    b = {r.doc_id: r.score for r in crf.classify(frame, spark.createDataFrame(flip, "doc_id long, quality int")).collect()}
    assert a == b


def test_few_labels(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in crf.classify(frame, none).collect()} == {1}
    assert {r.predicted for r in crf.classify(frame, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int")).collect()} == {0}
    assert crf.classify(frame.limit(0), none).collect() == []
