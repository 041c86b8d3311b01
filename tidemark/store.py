"""A warehouse folder of items, events and exposures, for batch jobs and the command line.

Tables are Parquet. A write first makes sure that it is whole and free of conflicts, then appends; the log numbers events
in order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark import schemas as S
from tidemark.functions.events import unused
from tidemark.operators import ingest as ing
from tidemark.sources import files
from tidemark.sources.tables import settle


def numbered(rows: DataFrame, order: list[str], out: str, after: int = 0) -> DataFrame:
    """rows with the column `out`: their places in the order, from after + 1 on.

    The rows are sorted by ranges, each of which is numbered by itself behind the sizes of the ranges before; only these
    sizes, one for each range, come together.
    """
    part, n, before = (unused(rows.columns, x) for x in ("part", "n", "before"))
    ranged = settle(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count("*").alias(n))
    sizes = sizes.select(part, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(n, own).join(F.broadcast(sizes), part).withColumn(out, (F.col(n) + F.col(before) + after).cast("long")).drop(part, n, before)


class Store:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema) -> DataFrame:
        path = f"{self.root}/{name}"
        if not files.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return ing.add_missing(self.spark.read.option("mergeSchema", "true").parquet(path), schema)

    def items(self) -> DataFrame:
        known = files.read_json(self.spark, f"{self.root}/items.json")
        return self.spark.read.schema(S.ITEMS).parquet(known["path"]) if known else self.spark.createDataFrame([], S.ITEMS)

    def put_items(self, rows: DataFrame) -> int:
        """Replace items by id: a new snapshot, then the pointer to it."""
        known = files.read_json(self.spark, f"{self.root}/items.json", {"version": 0})
        version = known["version"] + 1
        path = f"{self.root}/items/{version}"
        ing.put_items(self.items(), rows.select([f.name for f in S.ITEMS])).write.mode("overwrite").parquet(path)
        files.write_json(self.spark, f"{self.root}/items.json", {"version": version, "path": path})
        return self.items().count()

    def log(self) -> DataFrame:
        return self._table("events", S.LOG)

    def events(self) -> DataFrame:
        return self.log().select(S.EVENT_COLUMNS)

    def ingest(self, rows: DataFrame) -> ing.Ingested:
        """Append what is new, numbered by (timestamp, event_id) behind the log's last offset."""
        fresh, counts = ing.ingest(self.events(), rows)
        if counts.accepted:
            last = self.log().agg(F.max("source_offset").alias("m")).first().m or 0
            numbered(fresh, ["timestamp", "event_id"], "source_offset", last).select("source_offset", *S.EVENT_COLUMNS).write.mode("append").parquet(f"{self.root}/events")
        return counts

    def exposures(self) -> DataFrame:
        return self._table("exposures", S.EXPOSURES)

    def record_exposures(self, rows: DataFrame) -> None:
        ing.record_exposures(self.exposures(), rows.select([f.name for f in S.EXPOSURES])).write.mode("append").parquet(f"{self.root}/exposures")

    def stats(self) -> dict:
        return ing.stats(self.items(), self.events(), self.exposures()).first().asDict()
