"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents that are in the same sources form a pattern; only the sizes of the patterns reach the driver. There every
pattern can supply its size once at no cost, and again at a cost that rises with each repetition, to the quotas of the
sources it is in. The cheapest flow that fills the quotas says how much of each pattern goes where. Which documents
carry it follows from their places in a seeded order: a prefix sum in two steps, so no source is gathered in one task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 42
#: Parts of the seeded order of a pattern; each is summed up on its own.
PARTS = 4096
#: Patterns whose sizes the driver takes. Documents in one source each have as many as there are sources; a source that is
#: nearly as fine as the documents is refused rather than gathered.
PATTERNS = 1_000_000
#: A plan of so many patterns at most is broadcast (a few hundred bytes each); a larger one is joined by shuffle.
BROADCAST = 10_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float, most: float = REPEATS) -> dict[str, float]:
    """Shares of total by weight, none above `most` times its source's size; what is cut off is shared out again."""
    left, free, out = float(total), set(sizes), {}
    while free:
        weight = sum(weights[s] for s in sorted(free))
        full = [s for s in free if weight <= 0 or left * weights[s] / weight > most * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / weight for s in free}
        for s in sorted(full):
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= set(full)
        left = max(left, 0.0)
    return out


def min_cost_flow(supply: dict, quota: dict, repeats: int = REPEATS) -> dict:
    """{(pattern, source): amount} of the cheapest largest flow; a pattern is a tuple of its sources.

    The k-th use of a pattern costs (k - 1)^2 a word, so repetition is spread before it is deepened. Patterns that
    share no source are independent, and are solved one group after another by successive shortest paths.
    """
    group = {s: s for s in quota}

    def find(s):
        while group[s] != s:
            group[s] = s = group[group[s]]
        return s

    for p in supply:
        for s in p[1:]:
            group[find(s)] = find(p[0])
    by_group = defaultdict(list)
    for p in sorted(supply):
        if p and supply[p] > 0:
            by_group[find(p[0])].append(p)
    flow: dict = {}
    for root in sorted(by_group):
        flow |= _solve({p: supply[p] for p in by_group[root]}, quota, repeats)
    return flow


def _solve(supply: dict, quota: dict, repeats: int) -> dict:
    patterns, sources = list(supply), sorted({s for p in supply for s in p})
    place = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    n = 2 + len(place)
    to, room, cost, out = [], [], [], [[] for _ in range(n)]

    def edge(u, v, cap, c):
        for a, b, x, y in ((u, v, cap, c), (v, u, 0, -c)):
            out[a].append(len(to))
            to.append(b)
            room.append(x)
            cost.append(y)

    for p in patterns:
        for k in range(repeats):
            edge(0, place["p", p], supply[p], k * k)
        for s in p:
            edge(place["p", p], place["s", s], repeats * supply[p], 0)
    for s in sources:
        edge(place["s", s], 1, quota[s], 0)
    height = [0] * n  # all costs are reduced by these to zero or more
    while True:
        far, by = [None] * n, [None] * n
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if room[e] > 0 and (far[to[e]] is None or d + cost[e] + height[u] - height[to[e]] < far[to[e]]):
                    far[to[e]] = d + cost[e] + height[u] - height[to[e]]
                    by[to[e]] = e
                    heapq.heappush(heap, (far[to[e]], to[e]))
        if far[1] is None:
            break
        most = max(x for x in far if x is not None)
        height = [h + (most if x is None else x) for h, x in zip(height, far, strict=True)]
        path, v = [], 1
        while v:
            path.append(by[v])
            v = to[by[v] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    names = {i: k[1] for k, i in place.items()}
    return {(names[to[e ^ 1]], names[to[e]]): room[e ^ 1] for e in range(0, len(to), 2) if to[e ^ 1] > 1 and to[e] > 1 and room[e ^ 1] > 0}


def mix(docs: DataFrame, members: Column, size: Column, weights=None, total: float | None = None, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", mark: Column | None = None) -> DataFrame:
    """One row per row of docs: id, members, size, copies (a map of source to count), taken, source_sizes, targets.

    members is an array of the sources that a document is in; a null in it is a source of its own, last in order.
    weights maps the number of a source in that order to its weight (5, 2, 1 repeating, if none is given); total is the
    number of words to take (those of all documents, if none is given). mark, if given, is a number of a row's content:
    rows without id, or with one id, take places of their own by it.
    """
    weigh = weights or (lambda i: WEIGHTS[i % len(WEIGHTS)])
    spark = docs.sparkSession
    # A source as a key: "0" and its name, or "1" for null, so that keys sort as sources do.
    keys = F.array_sort(F.array_distinct(F.transform(F.coalesce(members, F.array().cast("array<string>")), lambda s: F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s)))))
    order = F.xxhash64(F.lit(seed), F.col("id"), "size", "mark")
    base = docs.select(F.col(id_col).alias("id"), keys.alias("pattern"), size.alias("size"), (F.lit(0) if mark is None else mark).cast("long").alias("mark"))
    # Rows that are alike in all that matters stand side by side; they are counted, and dealt with as one.
    base = base.select("*", order.alias("h")).groupBy("pattern", "id", "size", "h").agg(F.count("*").alias("alike"))
    base = stored(base.withColumn("bucket", F.pmod("h", F.lit(PARTS)).cast("int")), "mix")

    # One row for each pattern: the sources' own overlaps, not the documents, set its length.
    found = base.groupBy("pattern").agg(F.sum(F.col("size") * F.col("alike")).alias("n")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"the documents' sources form more than {PATTERNS} patterns")
    supply = {tuple(r.pattern): int(r.n) for r in found}
    sizes: dict[str, int] = defaultdict(int)
    for p, n in supply.items():
        for s in p:
            sizes[s] += n
    weight = {s: weigh(i) for i, s in enumerate(sorted(sizes))}
    goal = targets(sizes, weight, sum(supply.values()) if total is None else total, repeats)
    flow = min_cost_flow(supply, {s: round(t) for s, t in goal.items()}, repeats)
    plan = []
    for p in supply:
        spans, at = [], 0
        for s in p:
            if amount := flow.get((p, s), 0):
                spans.append((s, at, at + amount))
                at += amount
        plan.append((list(p), supply[p], at, spans, [sizes[s] for s in p], [goal[s] for s in p]))
    table = spark.createDataFrame(plan, "pattern array<string>, pattern_size long, flow long, spans array<struct<source string, start long, stop long>>, source_sizes array<long>, targets array<double>")
    table = F.broadcast(table) if len(plan) <= BROADCAST else table

    parts = base.groupBy("pattern", "bucket").agg(F.sum(F.col("size") * F.col("alike")).alias("n"))
    parts = parts.select("pattern", "bucket", (F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("pattern", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("upto", F.sum(F.col("size") * F.col("alike")).over(own)).join(parts, ["pattern", "bucket"]).join(table, "pattern")
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1))).withColumn("upto", F.col("upto") - F.col("nth") * F.col("size"))
    # Copy k of a document is a stretch of the pattern's line, laid out `repeats` times; its middle decides.
    middle = "before + upto - size + size / 2.0D + k * pattern_size"
    spots = f"transform(sequence(0, {repeats - 1}), k -> {middle})"
    taken = f"filter(transform({spots}, m -> filter(spans, x -> m >= x.start and m < x.stop)), x -> size(x) > 0)"
    placed = placed.withColumn("to", F.expr(f"case when size > 0 then transform({taken}, x -> x[0].source) else array() end"))
    counted = F.expr("map_from_arrays(array_distinct(to), transform(array_distinct(to), s -> size(filter(to, x -> x = s))))")
    return placed.select(F.col("id").alias(id_col), "pattern", "size", counted.alias("copies"), (F.size("to") * F.col("size")).alias("taken"), "source_sizes", "targets")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, each document being in its own source alone.

    Defined cases: a null text has size 0 and nothing of it is taken; a null source is a source of its own, last in
    order; rows without id, or with one id, take their places in the seeded order by their texts; repeated rows are
    separate documents, side by side; other columns are ignored; an empty table gives no rows. A source
    differs from its target by no more than one of its documents. A source may hold any share of all rows.
    """
    mixed = mix(docs, F.array(F.col(source)), words(text), repeats=repeats, seed=seed, id_col=id_col, mark=F.xxhash64(F.col(text)))
    return mixed.select(id_col, "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")
