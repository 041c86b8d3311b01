import hashlib
import random

import numpy as np
import xxhash

from tidemark.llm import common, simhash


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows, radius=3):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = [min([rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None], default=None) for i in range(len(rows))]
    return [(rows[i][0], f"{prints[i]:016x}", least[i]) for i in range(len(rows))]


def key(r):
    return tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as block", "2 as left").repartition(3)
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_documents(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps x", "zeta."]
    rows = []
    for i in range(60):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))]
        rows.append((3 * i, "\t ".join(base)))
        if i % 4 == 0 and len(base) > 100:
            for k in range(3):
                near = list(base)
                near[rng.randrange(len(near))] = "changed"
                rows.append((1000 - i * 3 - k, " ".join(near)))
    rows += [(2000, None), (2001, "  \n"), (None, rows[5][1]), (2002, rows[5][1]), (2002, rows[9][1]), (2003, "W " * 70_000)]
    check(spark, rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains and bunches over several blocks; nothing within the radius is missed, nothing beyond it is linked."""
    rng = random.Random(7)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 20)):
            prints.add(x)
            for _ in range(rng.randrange(0, 6)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "GROUP", 2)
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()

    def groups(pairs):
        root = {s: s for s in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in pairs:
            root[find(u)] = find(v)
        return [min(s for s in signed if find(s) == find(x)) for x in signed]

    near = [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert groups([(r.u, r.v) for r in got]) == groups(near)


# Near-duplicate texts


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_kept(rows):
    """(id, text) of the row that stays of each group, by Jaccard similarity of all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return sorted((rows[i] for i in range(len(rows)) if find(i) == i), key=str)


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
    return words


def similar_texts(seed, n):
    """Families of texts of 1 to 400 words, whose members differ by few or many edits."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    while len(rows) < n:
        origin = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 20, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            rows.append((len(rows), " ".join(edited(rng, origin, vocabulary, rng.randrange(1 + len(origin) // 15)))))
    return rows


def test_near_texts_against_brute_force(spark):
    rows = similar_texts(5, 700)
    rows += [(2000, rows[3][1]), (2001, rows[4][1].upper()), (None, rows[5][1]), (None, "a text without an id and without a like"), (7, rows[8][1]), (7, "another text of an id"), (8, None), (9, ""), (None, " \n"), rows[10], rows[10]]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, `_n` int").selectExpr("*", "1 as cls", "2 as key", "3 as row", "array(4) as root", "map('a', 1) as `m.n`").repartition(5)
    got = simhash.near_texts(docs)
    assert got.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    blank = lambda r: not (r[1] or "").strip()
    want = brute_kept(rows)
    assert sum(map(blank, got)) == sum(map(blank, want)) == 1 and [r for r in got if blank(r)][0][0] == 8
    assert [r for r in got if not blank(r)] == [r for r in want if not blank(r)]
    assert simhash.near_texts(docs.limit(0)).collect() == []


def test_a_dense_group_and_blocks(spark, monkeypatch):
    """Many texts near each other, and others near a few of them only, over many blocks."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    origin = rng.choices(vocabulary, k=120)
    rows = [(i, " ".join(edited(rng, origin, vocabulary, rng.randrange(4)))) for i in range(300)]
    rows += [(1000 + i, " ".join(edited(rng, origin, vocabulary, rng.randrange(3, 12)))) for i in range(100)]
    rows += [(5000 + i, " ".join(rng.choices(vocabulary, k=120))) for i in range(50)]
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "GROUP", 3)
    monkeypatch.setattr(simhash, "TEXTS", 30)
    monkeypatch.setattr(common, "GROUP", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in simhash.near_texts(docs).collect()), key=str)
    assert got == brute_kept(rows)


def test_recall_at_the_least_similarity():
    """Fingerprints of texts right above the similarity are within reach, those of unrelated ones are not."""
    import numpy as np

    rng, hit, total = random.Random(2), 0, 0
    for size in (9, 20, 45, 90, 450):
        for _ in range(150):
            common = [rng.getrandbits(63) for _ in range(size * 8 // 9)]
            a, b = (np.unique(np.array(common + [rng.getrandbits(63) for _ in range(size - len(common))], np.uint64)) for _ in range(2))
            x, y = simhash.wide_print(a), simhash.wide_print(b)
            hit += sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y)) <= simhash.REACH
            total += 1
    assert hit / total > 0.98
