"""Point-in-time user features and item popularity, for all requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import schemas as S
from tidemark.functions.events import EXACT, action_weight

#: A table of so many bytes at most, by Catalyst's own estimate, is sent to every task; a larger one is shuffled.
SMALL = 64 << 20


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint, if its estimated size allows it. What has no estimate is left to adaptive execution."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def named(items: DataFrame, events: DataFrame) -> DataFrame:
    """item_id, genres of the items that events name, sent to every task if items would be. A catalogue can be far larger
    than that, and what is sent passes through the driver's memory."""
    items = items.select("item_id", "genres")
    if small(items) is items:
        return items
    return F.broadcast(items.join(F.broadcast(events.select("item_id").distinct()), "item_id", "left_semi"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out to all shuffle partitions. Few bytes that much work hangs on would else be gathered into one task.

    It is dealt by a hash of the keys: were it by the keys themselves, rows that a join or an aggregate has already
    dealt by them would stay where they are, and adaptive execution merges those partitions into one.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def visible(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Each request's events: those of its user up to and including as_of."""
    r = requests.select("request_id", F.col("user_id").alias("_user"), "as_of")
    return events.join(r, (F.col("user_id") == F.col("_user")) & (F.col("timestamp") <= F.col("as_of"))).drop("_user")


def event_counts(seen: DataFrame) -> DataFrame:
    """All visible events of a request, of known items or not."""
    return seen.groupBy("request_id").agg(F.count("*").alias("event_count"))


def genre_weights(seen: DataFrame, items: DataFrame, key: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """The summed weights by genre, as exact decimals. Events of no weight still name their genres."""
    known = seen.join(small(items.select("item_id", "genres")), "item_id")
    part = (action_weight() / F.greatest(F.size("genres"), F.lit(1))).cast(EXACT)
    return known.select(*key, F.explode("genres").alias("genre"), part.alias("w")).groupBy(*key, "genre").agg(F.sum("w").alias("weight"))


def affinities(seen: DataFrame, items: DataFrame) -> DataFrame:
    """request_id, genre, affinity: the weights over the sum of their magnitudes, which counts as 1 at least."""
    total = F.sum(F.abs("weight")).over(Window.partitionBy("request_id"))
    scale = F.greatest(total.cast("double"), F.lit(1.0))
    return genre_weights(seen, items).select("request_id", "genre", F.round(F.col("weight").cast("double") / scale, 6).alias("affinity"))


def recent_items(seen: DataFrame, items: DataFrame, n: int = S.RECENT) -> DataFrame:
    """request_id, recent_items: the last n known items that were more than shown, oldest first, repeats included.

    A window ranks them, so only n rows of a request are ever gathered.
    """
    known = seen.filter("action <> 'impression'").join(small(items.select("item_id")), "item_id")
    last = Window.partitionBy("request_id").orderBy(F.desc("timestamp"), F.desc("event_id"))
    top = known.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= n)
    return top.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_n"), "item_id"))), lambda x: x["item_id"]).alias("recent_items"))


def user_features(requests: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """request_id, user_id, as_of, genre_affinity (a map), recent_items, event_count of every request."""
    seen, items = visible(requests, events), named(items, events)
    # One pass for weights and counts: an event is counted with its first genre, or as a row without any.
    part = (action_weight() / F.greatest(F.size("genres"), F.lit(1))).cast(EXACT)
    each = seen.join(items, "item_id", "left").select("request_id", part.alias("w"), F.posexplode_outer("genres").alias("pos", "genre"))
    sums = each.groupBy("request_id", "genre").agg(F.sum("w").alias("w"), F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("n"))
    total = F.sum(F.when(F.col("genre").isNotNull(), F.abs("w"))).over(Window.partitionBy("request_id"))
    scale = F.greatest(F.coalesce(total.cast("double"), F.lit(0.0)), F.lit(1.0))
    entry = F.when(F.col("genre").isNotNull(), F.struct("genre", F.round(F.col("w").cast("double") / F.col("scale"), 6).alias("affinity")))
    maps = sums.withColumn("scale", scale).groupBy("request_id").agg(F.sum("n").alias("event_count"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("genre_affinity"))
    joined = requests.join(maps, "request_id", "left").join(recent_items(seen, items), "request_id", "left")
    return joined.select(
        "request_id",
        "user_id",
        "as_of",
        F.coalesce("genre_affinity", F.create_map().cast("map<string,double>")).alias("genre_affinity"),
        F.coalesce("recent_items", F.array().cast("array<string>")).alias("recent_items"),
        F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"),
    )


def popularity(events: DataFrame, times: list[float] | None = None) -> DataFrame:
    """as_of, item_id, plays: how often each item was played, finished or liked up to each of `times`.

    An event is counted once, in the first of the times that see it; the counts then add up over the times, so the
    events are read and shuffled once however many times there are. Without times, as_of is null: all events count.
    """
    popular = events.filter(F.col("action").isin(*S.POPULAR))
    if times is None:
        return popular.groupBy("item_id").agg(F.count("*").alias("plays")).select(F.lit(None).cast("double").alias("as_of"), "item_id", "plays")
    marks = F.lit(sorted(set(times))).cast("array<double>") if times else F.array().cast("array<double>")
    first = popular.select("item_id", F.size(F.filter(marks, lambda t: t < F.col("timestamp"))).alias("slot")).groupBy("item_id", "slot").agg(F.count("*").alias("n"))
    per_item = first.groupBy("item_id").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))  # a row for each time at most
    each = per_item.select("item_id", "slots", F.posexplode(marks).alias("pos", "as_of"))
    plays = F.aggregate(F.filter("slots", lambda s: s["slot"] <= F.col("pos")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return each.select("as_of", "item_id", plays.alias("plays")).filter("plays > 0")


def popularity_scores(events: DataFrame, times: list[float] | None = None) -> DataFrame:
    """popularity with max_plays, of all items that were played, and popularity = log(1 + plays) / log(1 + max)."""
    counted = popularity(events, times)
    top = counted.groupBy(F.col("as_of").alias("_at")).agg(F.max("plays").alias("max_plays"))  # a row for each time
    joined = counted.join(F.broadcast(top), F.col("as_of").eqNullSafe(F.col("_at"))).drop("_at")
    return joined.withColumn("popularity", F.log1p("plays") / F.log1p("max_plays"))
