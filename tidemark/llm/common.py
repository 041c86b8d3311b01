"""What several operators share: work folders, tables, Arrow helpers and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.tables import settle, work_dir

__all__ = ["blocked", "components", "frugal", "meetings", "pieces", "settle", "star_links", "stored", "table", "unused", "work_dir"]


#: Blocks of one key that meet the same copy of another.
GROUP = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like `settle`, as a compressed table whose columns can be read one by one."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: Iterable[str], name: str) -> str:
    """A column name that none of `columns` has, whatever its case."""
    taken = {c.casefold() for c in columns}
    while (name := f"_{name}").casefold() in taken:
        pass
    return name


def pieces(batches: Iterator, column: str, size: int) -> Iterator:
    """The rows of Arrow batches, about `size` bytes of a text column at a time (one row at least).

    Only so much becomes Python objects at once, however large the batches are.
    """
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        end = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        at = 0
        while at < b.num_rows:
            done = int(end[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(end, done + size, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives unused memory back: workers outlive their tasks, and share an executor."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    edges has (u, v) of one orderable type; u and v may come in either order. Alternating large-star and small-star
    steps: each moves neighbours to the smallest one, on rows that never outnumber the links, and ends when a round
    changes nothing. Each round is written to the shared folder.
    """
    edges = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # A round is a function of the links before it, so equal counts and sums of hashes mean a fixed point.
    summary = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    state = edges.agg(*summary).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = settle(small.filter("u <> v").distinct())
        now = edges.agg(*summary).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def blocked(rows: DataFrame, key: list[str], blocks: Column, *columns: str, by: str = "cls") -> DataFrame:
    """(key, block, blocks, held): the rows of each key, dealt out to so many blocks as the aggregate `blocks` says."""
    # Only keys with more rows than a block holds are looked up, so the table is small beside the rows.
    large = stored(rows.groupBy(*key).agg(blocks.cast("int").alias("blocks")).filter("blocks > 1"), "large")
    dealt = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    return dealt.groupBy(*key, "block").agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct(*columns)).alias("held"))


def meetings(blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key, left, right): each two different blocks of one key, once."""
    cut = blocks.filter("blocks > 1")
    groups = F.sequence(F.expr(f"block div {GROUP}"), F.expr(f"(blocks - 1) div {GROUP}"))
    left = cut.select(*key, F.col("block").alias("own"), F.col("held").alias("left"), F.explode(groups).alias("part"))
    return left.join(cut.select(*key, "block", F.expr(f"block div {GROUP}").alias("part"), F.col("held").alias("right")), [*key, "part"]).filter("own < block").select(*key, "left", "right")


def star_links(i, j, n: int):
    """A spanning star for every component of the links i-j among n places, as arrays (place, root)."""
    import numpy as np

    root = np.arange(n)
    while True:
        low, new = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    place = np.flatnonzero(root != np.arange(n))
    return place, root[place]
