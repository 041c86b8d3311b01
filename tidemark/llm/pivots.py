"""Near-duplicate embeddings by a pivot permutation index.

A bounded sample of the vectors, no two of them close, serves as pivots: a dense group of near copies has one of them,
and its members agree on the rest, which they would not on a choice among each other. Every vector is described by its
nearest pivots in order, and stands in the inverted list of each. Two vectors that share at least SHARED of their NEAREST
pivots are found in the list of the first pivot that they share and nowhere else; they are candidates if a sketch of
their directions, 128 signs of fixed projections, doesn't put them far beyond the angle looked for. Lists hold numbers,
descriptions and sketches, no vectors, and are cut into blocks that meet two at a time, so a list of any length is
compared whole and never held by one task.

Candidates that hang together then send their vectors, once, to be verified among themselves by their cosine in double
precision. Equal vectors are one class with a count, and what leaves a pair of blocks is a count for each vector and a
spanning star for each bunch, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import blocked, components, frugal, meetings, settle, star_links, stored
from tidemark.llm.vectors import matrix, usable

COSINE = 0.98
#: Pivots by which a vector is described, and how many of them two candidates share at least.
NEAREST, SHARED = 8, 2
#: Pivots: the square root of the number of vectors within these bounds, so the index can be sent to every task.
PIVOTS = (64, 4096)
#: Pivots have a lower cosine than this with each other, and are chosen from so many times their number of vectors.
APART, POOL = 0.9, 4
#: Postings and vectors in a block.
LIST, BLOCK = 4096, 1024
#: Signs in a sketch (two words), and the seed of their projections.
SIGNS, SEED = 128, 42


def reach(cosine: float) -> int:
    """Signs of two sketches that may differ. Each differs with the chance of the angle over pi; beyond four standard
    deviations above that come fewer than one pair in two thousand."""
    import math

    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SIGNS * p + 3.8 * math.sqrt(SIGNS * p * (1 - p)))


def choose_pivots(vectors: DataFrame, n: int) -> list[list[float]]:
    """A sample that depends on the vectors alone: those with the smallest hashes, without any that is near another."""
    import numpy as np

    lo, hi = PIVOTS
    m = min(hi, max(lo, int(n**0.5)))
    rows = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(POOL * m).collect()
    pool = [np.array(r.vector, float) for r in rows]
    kept = {len(p): np.empty((0, len(p))) for p in pool}
    chosen: list[list[float]] = []
    for p in pool:
        if len(chosen) == m:
            break
        unit = p / np.abs(p).max()
        unit = unit / np.linalg.norm(unit)
        if (kept[len(p)] @ unit).max(initial=-1) < APART:
            kept[len(p)] = np.vstack([kept[len(p)], unit])
            chosen.append([float(x) for x in p])
    return chosen


def _unit(column):
    """The vectors of a list column as rows of length one."""
    import numpy as np

    v = matrix(column)
    v = v / np.abs(v).max(1, keepdims=True)  # squares of very large or small numbers would leave the range
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def post(vectors: DataFrame, pivots: list[list[float]], nearest: int = NEAREST) -> DataFrame:
    """A row (label, dim, pivot, cls, pivots, sketch) for each of the nearest pivots of each vector (cls, label, vector).

    pivots are their numbers as 16-bit integers, nearest first. A vector for whose dimension there is no pivot is
    described by pivot 0 alone: it is compared with all such.
    """
    import numpy as np

    by_dim: dict[int, list] = {}
    for i, p in enumerate(pivots):
        by_dim.setdefault(len(p), []).append((i, p))
    bases = {d: (np.array([i for i, _ in x], "<i2"), np.array([p for _, p in x])) for d, x in by_dim.items()}
    bases = {d: (i, p / np.abs(p).max(1, keepdims=True)) for d, (i, p) in bases.items()}
    bases = {d: (i, p / np.linalg.norm(p, axis=1, keepdims=True)) for d, (i, p) in bases.items()}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        planes: dict[int, object] = {}
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column("vector")))
            for d in map(int, np.unique(sizes)):
                rows = np.flatnonzero(sizes == d)
                ids, base = bases.get(d, (np.zeros(1, "<i2"), np.zeros((1, d))))
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).normal(size=(d, SIGNS))
                for at in range(0, len(rows), 4096):
                    some = pa.array(rows[at : at + 4096])
                    unit = _unit(b.column("vector").take(some))
                    close = unit @ base.T
                    k = min(nearest, len(ids))
                    best = np.argpartition(-close, k - 1, axis=1)[:, :k]
                    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(close, best, 1), axis=1, kind="stable"), 1)
                    perms, sketches = ids[best], np.packbits(unit @ planes[d] > 0, axis=1)
                    place = np.repeat(np.arange(len(some)), k)
                    fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()).take(pa.array(place))
                    own = some.take(pa.array(place))
                    yield pa.RecordBatch.from_arrays([b.column("label").take(own), pa.array(np.full(len(place), d, np.int32)), pa.array(perms.ravel().astype(np.int32)), b.column("cls").take(own), fixed(perms), fixed(sketches)], names=["label", "dim", "pivot", "cls", "pivots", "sketch"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("cls", "label", "vector").mapInArrow(frugal(run), f"label {kind}, dim int, pivot int, cls long, pivots binary, sketch binary")


def compare(pivot: int, a: dict, b: dict | None, radius: int, shared: int):
    """Places (i, j) of the candidates among two blocks of one inverted list, or within one, found in no other list."""
    import numpy as np

    found, same = [], b is None
    b = a if b is None else b
    for at in range(0, len(a["cls"]), 128):
        part = slice(at, at + 128)
        far = np.bitwise_count(a["sketch"][part, None, 0] ^ b["sketch"][None, :, 0])
        far += np.bitwise_count(a["sketch"][part, None, 1] ^ b["sketch"][None, :, 1])
        i, j = np.nonzero(far <= radius)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            pa, pb = a["pivots"][x], b["pivots"][y]
            both = (pa[:, :, None] == pb[:, None, :]).any(2)
            first = np.where(both, pa, np.iinfo(np.int16).max).min(1)
            fit = (both.sum(1) >= min(shared, pa.shape[1])) & (first == pivot)
            found.append((x[fit], y[fit]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _stars(cls, i, j):
    """The links i-j among numbers cls as a spanning star for each bunch, in numbers."""
    import numpy as np

    ids, at = np.unique(cls, return_inverse=True)
    place, root = star_links(at[i], at[j], len(ids))
    return ids[place], ids[root]


def candidates(classes: DataFrame, pivots: list[list[float]], cosine: float = COSINE, shared: int = SHARED) -> DataFrame:
    """(u, v): spanning stars of the classes that are candidates of each other, for each pair of blocks."""
    posted = stored(post(classes, pivots), "postings")
    key, radius = ["label", "dim", "pivot"], reach(cosine)
    blocks = stored(blocked(posted, key, F.ceil(F.count("*") / LIST), "cls", "pivots", "sketch"), "lists")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def load(held) -> dict:
            table = lambda f, kind: np.frombuffer(b"".join(held.field(f).to_pylist()), kind).reshape(len(held), -1)
            return {"cls": np.asarray(held.field("cls")), "pivots": table("pivots", "<i2"), "sketch": table("sketch", "<u8")}

        for batch in batches:
            u, v = [], []
            for r in range(batch.num_rows):
                a = load(batch.column("left")[r].values)
                b = load(batch.column("right")[r].values) if batch.column("right")[r].is_valid else None
                i, j = compare(batch.column("pivot")[r].as_py(), a, b, radius, shared)
                if len(i):
                    both = _stars(a["cls"] if b is None else np.concatenate([a["cls"], b["cls"]]), i, j if b is None else j + len(a["cls"]))
                    u.append(both[0])
                    v.append(both[1])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    alone = blocks.select("pivot", F.col("held").alias("left"), F.lit(None).cast(blocks.schema["held"].dataType).alias("right"))
    work = [alone, meetings(blocks, key).select("pivot", "left", "right")]
    found = [w.mapInArrow(frugal(run), "u long, v long") for w in work]
    return found[0].unionByName(found[1])


def near_vectors(classes: DataFrame, groups: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(u, v, n): for v null, n vectors are linked to those of class u in some blocks; else a link of a spanning star.

    classes has cls, vector and copies; groups (node, root) says which of them may be near, all else is far apart.
    """
    rows = groups.select(F.col("node").alias("cls"), "root").join(classes.select("cls", "copies", "vector"), "cls")
    blocks = stored(blocked(rows, ["root"], F.ceil(F.count("*") / BLOCK), "cls", "copies", "vector"), "groups")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            u, v, n = [], [], []
            for r in range(batch.num_rows):
                x, y = batch.column("left")[r].values, batch.column("right")[r].values
                a, cls, copies = _unit(x.field("vector")), np.asarray(x.field("cls")), np.asarray(x.field("copies"))
                if y is None:
                    hit = np.triu(a @ a.T >= cosine, 1)
                    i, j = np.nonzero(hit)
                    count = hit @ copies + copies @ hit
                else:
                    hit = a @ _unit(y.field("vector")).T >= cosine
                    i, j = np.nonzero(hit)
                    other = np.asarray(y.field("copies"))
                    count = np.concatenate([hit @ other, copies @ hit])
                    cls, j = np.concatenate([cls, np.asarray(y.field("cls"))]), j + len(cls)
                if not len(i):
                    continue
                some = np.flatnonzero(count)
                place, root = _stars(cls, i, j)
                u += [cls[some], place]
                v += [np.full(len(some), -1), root]
                n += [count[some].astype(np.int64), np.zeros(len(place), np.int64)]
            if u:
                v = np.concatenate(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(v, mask=v < 0), pa.array(np.concatenate(n))], names=["u", "v", "n"])

    alone = blocks.select(F.col("held").alias("left"), F.lit(None).cast(blocks.schema["held"].dataType).alias("right"))
    found = [w.select("left", "right").mapInArrow(frugal(run), "u long, v long, n long") for w in (alone, meetings(blocks, ["root"]))]
    return found[0].unionByName(found[1])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine is at least `cosine`. Defined cases: a vector
    that is null, empty, zero or holds a null or a non-finite component links with nothing, as does one without label;
    vectors of different dimensions don't link. Rows that repeat an id are vectors of their own. A null id counts as a
    link of others; its component is the smallest id it reaches, null if there is none, and it is not kept. Other
    columns are ignored; an empty table gives no rows.
    """
    v = F.col(vector)
    if rows.schema[vector].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    ok = usable(F.col(vector)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(label).isNotNull()
    # Vectors are told apart by two hashes of 64 bits, so they move only where they are compared.
    hashes = {"h1": F.xxhash64(F.lit(1), "vector"), "h2": F.xxhash64(F.lit(2), "vector", F.lit(3))}
    base = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), v.alias("vector"), ok.alias("ok"))
    key = ["label", "h1", "h2"]
    # Written once, as the classes' numbers must stay the same when a lost executor's work is repeated.
    grouped = base.filter("ok").withColumns(hashes).groupBy(*key).agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    classes = stored(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    alone = base.filter(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not n:
        return _result(alone, id_col)
    groups = stored(components(candidates(classes, choose_pivots(classes, n), cosine)), "near")
    found = settle(near_vectors(classes, groups, cosine))
    links = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("near"))
    roots = components(found.filter("v is not null").select("u", "v"))
    known = classes.select("cls", *key, "copies", "least").join(links.withColumnRenamed("u", "cls"), "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    known = settle(known.select(*key, "least", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = settle(known.join(least, "root").select(*key, "n_links", "component_id"))
    linked = base.filter("ok").withColumns(hashes).select("id", *key).join(known, key).select("id", "n_links", "component_id")
    return _result(linked.unionByName(alone), id_col)


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the links counted by `exact` that `found` counts, both as near_duplicates returns them; 1 if none."""
    total = lambda df: df.agg(F.sum("n_links")).first()[0] or 0
    known = total(exact)
    return total(found) / known if known else 1.0
