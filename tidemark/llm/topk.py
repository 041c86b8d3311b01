"""Exact top-k inner products by vector-approximation files.

Components become integers floor(256 x). The approximation of a vector is the number of a cell for every component, and
cells have known edges, so the small codes alone bound every score from both sides. A first scan of the codes finds the
kth best of the lower bounds for each query: no row whose upper bound is below can be in the result. A second scan
names the rows that are left, and only blocks that hold some send their exact vectors, once. These are read in the order
of their bounds, best first, until no bound left can reach the kth score. Rows and queries are cut into blocks; of equal
vectors only the rows that can be among the k best of their score, by id, take part as candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import frugal, settle, stored
from tidemark.llm.vectors import matrix, usable

SCALE = 256
#: Rows and queries in a block, and exact vectors read at a time.
ROWS, QUERIES, STEP = 4096, 8192, 64
#: Cells for each component; their edges are quantiles of the block, stored with it.
CELLS = 64
#: Queries whose bounds are held at a time.
TOGETHER = 256
#: Sums below this are exact in double precision; the bounds of larger ones are widened by this share.
EXACT, SLACK = 2.0**53, 2.0**-40
#: Scores are cut to the range of a long, and so are their bounds.
REACH = 2.0**63


def quantise(vectors, cells: int = CELLS):
    """Codes (rows by components) and the lowest and highest value in each cell of each component."""
    import numpy as np

    edges = np.quantile(vectors, np.arange(1, cells) / cells, axis=0, method="lower") if len(vectors) else np.zeros((cells - 1, vectors.shape[1]))
    codes = np.empty(vectors.shape, np.uint8)
    low, high = np.zeros((cells, vectors.shape[1])), np.zeros((cells, vectors.shape[1]))
    for d in range(vectors.shape[1]):
        codes[:, d] = np.searchsorted(edges[:, d], vectors[:, d], side="left")
        order = np.argsort(codes[:, d], kind="stable")
        found, start = np.unique(codes[order, d], return_index=True)
        low[found, d] = np.minimum.reduceat(vectors[order, d], start)
        high[found, d] = np.maximum.reduceat(vectors[order, d], start)
    return codes, low, high


class Bounds:
    """What the codes of a block say of inner products."""

    def __init__(self, codes, low, high):
        import numpy as np

        at = np.arange(codes.shape[1])
        self.low, self.high = low[codes, at].T, high[codes, at].T
        self.most = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))

    def _slack(self, queries) -> float:
        import numpy as np

        reach = float(len(self.low)) * float(self.most) * float(np.abs(queries).max(initial=0))
        return reach * SLACK if reach >= EXACT else 0.0

    def upper(self, queries):
        import numpy as np

        return np.clip(np.maximum(queries, 0) @ self.high + np.minimum(queries, 0) @ self.low + self._slack(queries), -REACH, REACH)

    def lower(self, queries):
        import numpy as np

        return np.clip(np.maximum(queries, 0) @ self.low + np.minimum(queries, 0) @ self.high - self._slack(queries), -REACH, REACH)


def read(order, upper, vectors, ids, lost, query, own, k: int):
    """(places, scores) of the k best of the rows at `order`, whose upper bounds descend; the row `own` is left out.

    Ties go to the smaller id, rows without id (lost) last. Exact vectors are read until the kth result is certain.
    """
    import numpy as np

    reach = float(len(query)) * float(np.abs(query).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    best, scores = np.empty(0, np.int64), np.empty(0, object if reach >= EXACT else float)
    at, step = 0, STEP
    while at < len(order):
        if len(best) >= k and upper[at] < scores[k - 1]:  # a bound that only ties may still win by its id
            break
        some = order[at : at + step]
        at, step = at + step, 2 * step
        some = some[some != own]
        if reach >= EXACT:
            whole = [int(x) for x in query]
            found = np.array([min(max(sum(a * int(b) for a, b in zip(whole, vectors[r], strict=True)), -(2**63)), 2**63 - 1) for r in some], dtype=object)
        else:
            found = vectors[some].astype(float) @ query.astype(float)
        best, scores = np.append(best, some), np.append(scores, found)
        top = np.lexsort((ids[best], lost[best], -scores))[:k] if reach < EXACT else np.array(sorted(range(len(best)), key=lambda i: (-scores[i], lost[best[i]], ids[best[i]]))[:k], np.int64)
        best, scores = best[top], scores[top]
    return best, scores


def top_k(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id and score: the k rows with the highest inner products for each query row.

    Queries are the rows whose id is divisible by `every`; a query's candidates are all rows but itself. Ties go to the
    smaller id, rows without id last. Defined cases: a vector that is null or holds a null or a non-finite component
    takes no part; vectors of different dimensions don't meet; rows that repeat an id are rows of their own, as queries
    (each has its own ranks from 1) and as candidates (of each other, too); a row without id is a candidate, and no
    query. Components beyond 2^62 are cut to that, scores to the range of a long. Other columns are ignored; an empty
    table gives no rows.
    """
    whole = F.transform(F.col("v").cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long"))
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v")))
    # Written once, as the rows' numbers must stay the same when a lost executor's work is repeated.
    base = stored(base.select("id", whole.alias("v")).withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")
    alike = Window.partitionBy("v").orderBy(F.col("id").isNull(), "id", "row")
    able = base.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1).drop("n")
    asked = base.filter(F.col("id") % every == 0)

    def blocks(df: DataFrame, size: int, *columns: str) -> DataFrame:
        count = df.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
        dealt = df.join(count, "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        return dealt.groupBy("dim", "block").agg(F.collect_list(F.struct(*columns)).alias("held"))

    exact = stored(blocks(able, ROWS, "row", "id", "v"), "exact")

    # Approximation files: the codes and cell edges of each block, without the vectors.
    def approximate(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                held = b.column("held")[r].values
                small = [pa.array([x.tobytes()], pa.binary()) for x in quantise(matrix(held.field("v")))]
                yield pa.RecordBatch.from_arrays([b.column("dim").slice(r, 1), b.column("block").slice(r, 1), pa.array([np.asarray(held.field("row"))]), *small], names=["dim", "block", "rows", "codes", "low", "high"])

    tasks = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * base.sparkSession.sparkContext.defaultParallelism)
    files = stored(exact.mapInArrow(frugal(approximate), "dim int, block int, rows array<long>, codes binary, low binary, high binary").repartition(tasks, "dim", "block"), "cells")

    def pairs(ask: DataFrame) -> DataFrame:
        """The stated query set against all rows, in blocks: each block of codes goes to every block of queries once."""
        ask = ask.withColumnsRenamed({"block": "part", "held": "queries"})
        parts = ask.groupBy("dim").agg(F.collect_set("part").alias("parts"))
        return files.join(parts, "dim").withColumn("part", F.explode("parts")).drop("parts").join(ask, ["dim", "part"])

    def scanned(batches: Iterator) -> Iterator:
        """(batch, row, bounds, places of the block's rows, queries, vectors of queries) for each pair."""
        import numpy as np

        for b in batches:
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                numbers = np.asarray(b.column("rows")[r].values)
                codes = np.frombuffer(b.column("codes")[r].as_py(), np.uint8).reshape(len(numbers), dim)
                low, high = (np.frombuffer(b.column(x)[r].as_py()).reshape(CELLS, dim) for x in ("low", "high"))
                held = b.column("queries")[r].values
                q = matrix(held.field("v"), "f8").reshape(len(held), dim)
                yield b, r, Bounds(codes, low, high), numbers, held, q

    def own_places(numbers, asked):
        """The place of each asked row among numbers, -1 where it isn't."""
        import numpy as np

        order = np.argsort(numbers)
        at = np.minimum(np.searchsorted(numbers, asked, sorter=order), len(numbers) - 1)
        return np.where(numbers[order[at]] == asked, order[at], -1)

    def first(batches: Iterator) -> Iterator:
        """The k best lower bounds that a block has for each query."""
        import numpy as np
        import pyarrow as pa

        for _, _, bounds, numbers, held, q in scanned(batches):
            ids = np.asarray(held.field("row"))
            own = own_places(numbers, ids)
            for i in range(0, len(q), TOGETHER):
                low = bounds.lower(q[i : i + TOGETHER])
                mine = np.flatnonzero(own[i : i + TOGETHER] >= 0)
                low[mine, own[i : i + TOGETHER][mine]] = -np.inf
                best = low if low.shape[1] <= k else np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
                x, y = np.nonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + TOGETHER][x]), pa.array(best[x, y])], names=["row", "bound"])

    def second(batches: Iterator) -> Iterator:
        """The rows of a block that can be among the k best of a query, as places of both, with their upper bounds."""
        import numpy as np
        import pyarrow as pa

        for b, r, bounds, numbers, held, q in scanned(batches):
            least = np.nan_to_num(np.asarray(held.field("least").fill_null(-np.inf)), nan=-np.inf, neginf=-np.inf)
            own, found = own_places(numbers, np.asarray(held.field("row"))), []
            for i in range(0, len(q), TOGETHER):
                up = bounds.upper(q[i : i + TOGETHER])
                x, y = np.nonzero(up >= least[i : i + TOGETHER, None])
                other = own[i + x] != y
                found.append((i + x[other], y[other], up[x[other], y[other]]))
            x, y, up = (np.concatenate(z) for z in zip(*found, strict=True))
            if len(x):
                order = np.lexsort((-up, x))
                data = [x[order].astype("<i4"), y[order].astype("<i4"), up[order].astype("<f8")]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(r, 1) for c in ("dim", "block", "part")] + [pa.array([z.tobytes()], pa.binary()) for z in data], names=["dim", "block", "part", "asks", "places", "upper"])

    def third(batches: Iterator) -> Iterator:
        """The k best rows of a block for each query, read from the exact vectors."""
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                held, ask = b.column("held")[r].values, b.column("queries")[r].values
                vectors, q = (matrix(z.field("v"), "i8").reshape(len(z), -1) for z in (held, ask))
                lost = np.asarray(held.field("id").is_null())
                ids, numbers = np.asarray(held.field("id").fill_null(0)), np.asarray(held.field("row"))
                x, y, up = (np.frombuffer(b.column(c)[r].as_py(), kind) for c, kind in (("asks", "<i4"), ("places", "<i4"), ("upper", "<f8")))
                rows = np.asarray(ask.field("row"))
                own, cut, out = own_places(numbers, rows), np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x)), []
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    best, scores = read(y[i:j], up[i:j], vectors, ids, lost, q[x[i]], own[x[i]], k)
                    out += [(int(rows[x[i]]), int(ask.field("id")[int(x[i])].as_py()), None if lost[p] else int(ids[p]), int(numbers[p]), int(s)) for p, s in zip(best, scores, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out, strict=True)], names=["query", "query_id", "id", "row", "score"])

    ask = stored(blocks(asked, QUERIES, "row", "v"), "queries")
    lower = pairs(ask).mapInArrow(frugal(first), "row long, bound double")
    by_bound = Window.partitionBy("row").orderBy(F.desc("bound"))
    least = lower.withColumn("n", F.row_number().over(by_bound)).filter(F.col("n") <= k).filter(F.col("n") == k).select("row", F.col("bound").alias("least"))
    ask = stored(blocks(asked.join(least, "row", "left"), QUERIES, "row", "id", "v", "least"), "queries")
    left = settle(pairs(ask).mapInArrow(frugal(second), "dim int, block int, part int, asks binary, places binary, upper binary"))
    held = left.join(ask.withColumnsRenamed({"block": "part", "held": "queries"}), ["dim", "part"]).join(exact, ["dim", "block"])
    best = held.select("held", "queries", "asks", "places", "upper").mapInArrow(frugal(third), "query long, query_id long, id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").isNull(), "id", "row"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
