import hashlib
import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidemark.llm import crf, mixing, secrets, simhash, stages  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows):
    """The smallest of each group of texts that share four fifths of their 5-word shingles."""
    rows, kept = sorted(set(rows)), []
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return [rows[i] for i in range(len(rows)) if group[i] == i]


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "river", "stone", "walks", "and", "light", "Morning,", "slowly.", "field", "under", "a", "was"]
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randrange(5, 40))) for _ in range(rng.randrange(1, 8))]
        good = rng.random() < 0.8
        if not good:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        if good and i % 10 == 0:
            lines.append("token = 1eb9c654e721b4f812088970e66a6345cee33dd6")
        rows.append((i, "\n".join(lines), "en", rng.choice(["s0", "s0", "s1", None]), 0))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[i][1], "en", "s1", 0) for i in range(0, 30, 3)]
    rows.append(rows[5])
    return [(i, t, c, s, len(t)) for i, t, c, s, _ in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "secret_scan", "source_mixing", "bpe_encoding"]
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema) if name != "bpe_encoding" else stage(spark, docs, folder)
        out.append(docs.collect())
        if name != "bpe_encoding":
            assert docs.columns == COLUMNS
    rows, labels = corpus()
    quality = {i: q for i, q, _ in labels}
    # 1: bad documents go, copies of good ones stay
    text = {i: t for i, t, *_ in rows}
    assert sorted(r.doc_id for r in out[0]) == sorted(i for i, t, *_ in rows if "###" not in t)
    # 2: one of each group
    assert sorted((r.doc_id, r.text) for r in out[1]) == brute_kept([(r.doc_id, r.text) for r in out[0]])
    # 3: the same documents, without secrets
    assert sorted(r.doc_id for r in out[2]) == sorted(r.doc_id for r in out[1])
    for r in out[2]:
        assert r.text == re.sub(r"(token = )[0-9a-f]{40}", r"\1[SECRET]", text[r.doc_id]) and r.n_chars == len(r.text)
    # 4: every source near its target
    size = lambda t: len(re.findall(mixing.WORD, t))
    sizes = {}
    for r in out[2]:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    key = {s: (s is None, s or "") for s in sizes}
    goal = mixing.targets({key[s]: n for s, n in sizes.items()}, {key[s]: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=key.get))}, sum(sizes.values()))
    for s in sizes:
        assert abs(sum(size(r.text) for r in out[3] if r.source == s) - goal[key[s]]) <= max(size(r.text) for r in out[2] if r.source == s) + 1
    # 5: a row of ids for every row
    assert sorted(r.doc_id for r in out[4]) == sorted(r.doc_id for r in out[3])
    assert all(hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in out[4])


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(map(str, got.collect())) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


CLASHES = ["size", "ids", "fp", "pattern", "_text", "_score", "_SCORE2", "_n", "_s", "_id", "_found", "__Found", "_copies", "row", "key", "cls", "root", "copies", "taken", "Score", "found", "FOUND2", "order", "h", "bucket", "id"]


def test_odd_rows(spark, folder):
    """Nulls in any column, empty texts, repeated rows and more columns, of whatever names, pass every stage as they are."""
    secret = "1eb9c654e721b4f812088970e66a6345cee33dd6"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (None, None, None, None, None), (3, "x " * 9, "en", "s", 18), (3, "x " * 9, "en", "s", 18), (4, "password=abcdef", "en", None, 15), (5, f"token = {secret}", "en", "t", 48)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'{c}' as `{c}`" for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.count() >= 0
        if name != "bpe_encoding":
            assert docs.columns == before.columns == [*COLUMNS, *CLASHES]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert all(r[c] == c for r in docs.collect() for c in CLASHES)
        if name == "simhash_near_dedup":
            assert docs.filter("doc_id is null").count() == 1 and docs.filter("doc_id = 3").count() == 1
        if name == "secret_scan":
            found = {r.doc_id: r for r in docs.collect()}
            assert found[5].text == "token = [SECRET]" and found[5].n_chars == 16 and secret not in str(found)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_thresholds():
    assert crf.THRESHOLD == 0.3 and simhash.SEED == 42 and secrets.KINDS[0] == "assign" and stages.quality
