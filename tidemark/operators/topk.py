"""Maximum inner products: the k best items for each query, exactly, and approximately by hashing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.events import dot

#: Scores are rounded to so many places, so that equal items tie whatever the order of summation.
PLACES = 10


def top_k_without(queries: DataFrame, items: DataFrame, k: int, left_out: DataFrame, most: int) -> DataFrame:
    """exact_top_k without the items that a query leaves out: left_out has query_id and items, an array of `most` or
    fewer. As many more are found as can be left out, so blocks are searched as they are, and no pair is listed."""
    found = _distinct_top_k(queries, items, k + most).join(left_out.select("query_id", F.col("items").alias("_out")), "query_id", "left")
    found = found.filter(~F.coalesce(F.array_contains("_out", F.col("item_id")), F.lit(False))).drop("_out", "rank")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def _distinct_top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """exact_top_k, in which queries with the same vector are asked once, and of items with the same vector and bias,
    which tie for every query, only the k first can be found."""
    alike = Window.partitionBy("v", "bias").orderBy("item_id")
    held = items.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= k).drop("_n")
    asked = queries.groupBy("q").agg(F.min("query_id").alias("_first"))
    found = exact_top_k(asked.select(F.col("_first").alias("query_id"), "q"), held, k).withColumnRenamed("query_id", "_first")
    return queries.join(asked, "q").select("query_id", "_first").join(found, "_first").drop("_first")


def exact_top_k(queries: DataFrame, items: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, rank, item_id, score: the k items with the highest q.v + bias, ties to the smaller item.

    queries has query_id and q, items has item_id, v and bias; allowed, if given, has the (query_id, item_id) that may
    be found. Blocks of items meet blocks of queries as matrices; only k rows for each query leave a pair of blocks.
    """
    if allowed is not None:
        pairs = allowed.join(queries, "query_id").join(items, "item_id").withColumn("score", F.round(dot(F.col("q"), F.col("v")) + F.col("bias"), PLACES))
    else:
        pairs = _blocked(queries, items, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def _blocked(queries: DataFrame, items: DataFrame, k: int, rows: int = 8192, asked: int = 1024, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best items for each query and pair of blocks; by has columns in which a query and its items have to agree."""
    if by:  # buckets differ in size, so each has as many parts and groups as it needs
        sizes = [df.groupBy(*by).agg(F.ceil(F.count("*") / n).cast("long").alias(name)) for df, n, name in ((items, rows, "_parts"), (queries, asked, "_groups"))]
        # A projection is no longer than a vector, so a table has some 2 / length + 2 buckets, whatever the rows are.
        both = F.broadcast(sizes[0].join(sizes[1], list(by)))
        left, right = items.join(both, list(by)), queries.join(both, list(by))
        parts, groups = F.col("_parts"), F.col("_groups")
    else:
        n, m = items.count(), queries.count()
        left, right, parts, groups = items, queries, F.lit(max(1, -(-n // rows))), F.lit(max(1, -(-m // asked)))
    left = left.withColumns({"_part": F.pmod(F.xxhash64("item_id"), parts), "_last": (groups - 1).cast("long")})
    left = left.groupBy(*by, "_part").agg(F.collect_list(F.struct("item_id", "v", "bias")).alias("items"), F.first("_last").alias("_last"))
    right = right.groupBy(*by, F.pmod(F.xxhash64("query_id"), groups).alias("group")).agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
    # Every block of items goes to every block of queries once; a block of queries is the unit of work.
    work = left.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).join(right, [*by, "group"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                own, ask = b.column("items")[r].values, b.column("queries")[r].values
                dim = len(own.field("v")[0])
                v = np.asarray(own.field("v").flatten(), "f8").reshape(-1, dim)
                q = np.asarray(ask.field("q").flatten(), "f8").reshape(-1, dim)
                score = np.round(q @ v.T + np.asarray(own.field("bias"), "f8"), PLACES)
                names = own.field("item_id").to_pylist()
                by_name = np.array(sorted(range(len(names)), key=names.__getitem__))
                score = score[:, by_name]
                most = min(k, len(names))
                least = -np.partition(-score, most - 1, axis=1)[:, most - 1]
                top = np.empty((len(q), most), np.int64)
                for x in range(len(q)):  # whatever reaches the kth score, in the order of names: ties go to the first
                    fit = np.flatnonzero(score[x] >= least[x])
                    top[x] = fit[np.argsort(-score[x, fit], kind="stable")[:most]]
                yield pa.RecordBatch.from_arrays(
                    [ask.field("query_id").take(pa.array(np.repeat(np.arange(len(q)), top.shape[1]))), own.field("item_id").take(pa.array(by_name[top.ravel()])), pa.array(np.take_along_axis(score, top, 1).ravel())],
                    names=["query_id", "item_id", "score"],
                )

    kinds = {f.name: f.dataType.simpleString() for df in (queries, items) for f in df.schema.fields}
    return work.select("items", "queries").mapInArrow(run, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")


def approximate_top_k(queries: DataFrame, items: DataFrame, k: int, tables: int = 8, length: float = 0.5, seed: int = 17) -> DataFrame:
    """Like exact_top_k, among the items that share a hash bucket with the query.

    Inner products become distances by one more dimension that makes all items equally long; random projections then
    put what is near into one bucket. Recall is measured, not promised.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    square = dot(F.col("x"), F.col("x"))
    raised = items.withColumn("x", F.concat("v", F.array("bias"))).withColumn("s", square)
    top = raised.agg(F.max("s").alias("m")).first().m or 0.0
    raised = raised.withColumn("features", array_to_vector(F.concat("x", F.array(F.sqrt(F.greatest(F.lit(top) - F.col("s"), F.lit(0.0)))))))
    unit = queries.withColumn("x", F.concat("q", F.array(F.lit(1.0))))
    scale = F.lit(top**0.5) / F.sqrt(dot(F.col("x"), F.col("x")))
    unit = unit.withColumn("features", array_to_vector(F.concat(F.transform("x", lambda y: y * scale), F.array(F.lit(0.0)))))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=length * top**0.5, numHashTables=tables, seed=seed).fit(raised)
    # Blocks of the items of a bucket meet blocks of its queries: no pair is listed, only k rows for each query and block
    # are. The k best of all that share a bucket are among the k best of each bucket.
    asked, held = (model.transform(df).select(*kept, F.posexplode("hashes").alias("_t", "_h")).withColumn("_h", vector_to_array("_h")[0].cast("long")) for df, kept in ((unit, ["query_id", "q"]), (raised, ["item_id", "v", "bias"])))
    found = _blocked(asked, held, k, by=("_t", "_h")).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of the exact k that was found."""
    both = found.select("query_id", "item_id").join(exact.select("query_id", "item_id"), ["query_id", "item_id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    return exact.select("query_id").distinct().join(both, "query_id", "left").agg(F.avg(F.coalesce("n", F.lit(0)) / k).alias("recall"))
