"""Candidates, scores, explanations and diverse slates for all requests at once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas as S
from tidemark.operators.experiments import assign
from tidemark.operators.features import popularity_scores, small, spread, user_features
from tidemark.sources.tables import settle


def times_of(requests: DataFrame) -> list[float]:
    """The distinct points in time of the requests: those of a batch are few, and only they reach the driver."""
    return sorted(r.as_of for r in requests.select("as_of").distinct().collect())


#: Items that meet a request together at most, requests that a task has (a file's dictionaries end at 1 MB each, and
#: without them nothing is a run), rows that a task makes, and items that are put in order together.
CHUNK, ASKED, TASK, SORTED = 256, 20_000, 5_000_000, 250_000


def candidates(features: DataFrame, items: DataFrame) -> DataFrame:
    """Every item that isn't among a request's recent ones, beside the request's features.

    Scoring is defined for each user and item, so the rows are as many as requests times items, and their order decides
    what they take on disk: see `_met`. Most items are nobody's recent ones: those that are someone's are marked once,
    and only these are looked up in a request's list.
    """
    features = settle(features)
    chunks = _chunks(_marked(features, items), ["_seen"], [])
    held = chunks.groupBy("_chunk", "_seen").agg(F.sort_array(F.collect_list(F.struct("item_id", *(c for c in items.columns if c != "item_id")))).alias("_items"))
    rows = _met(held, features, items).select(*features.columns, "_seen", F.explode("_items").alias("_item"))
    return rows.select(*features.columns, "_seen", *(F.col("_item")[c].alias(c) for c in items.columns)).filter(_open()).drop("_seen")


def _open() -> Column:
    """Whether an item may be shown to a request."""
    return ~(F.col("_seen") & F.array_contains("recent_items", F.col("item_id")))


def _marked(features: DataFrame, items: DataFrame) -> DataFrame:
    """items with `_seen`: whether any request has it among its recent ones."""
    recent = features.select(F.explode("recent_items").alias("item_id")).distinct().withColumn("_seen", F.lit(True))
    return items.join(recent, "item_id", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))


def _chunks(items: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """items with `_chunk`, which is equal for those that meet requests together: a few that are the same in some columns
    and next to each other in an order.

    A file packs places of its dictionary by fewer bits than a byte has: they recur byte by byte if a chunk's items are
    a multiple of eight, so what is left over makes a chunk of its own.
    """
    n, parts = items.count(), int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(8, min(CHUNK, n // (2 * parts) // 8 * 8))
    deal = F.pmod(F.xxhash64("item_id"), F.lit(max(1, n // SORTED if same and order else n // (16 * size))))
    group = Window.partitionBy(*same, "_deal")
    rows = items.withColumn("_deal", deal).withColumn("_n", F.row_number().over(group.orderBy(*order, "item_id"))).withColumn("_all", F.count("*").over(group))
    place = F.when(F.col("_n") > F.col("_all") - F.col("_all") % 8, -1).otherwise(F.floor((F.col("_n") - 1) / size))
    return rows.withColumn("_chunk", F.struct("_deal", place.alias("place"))).drop("_deal", "_n", "_all")


def _met(held: DataFrame, features: DataFrame, items: DataFrame) -> DataFrame:
    """Each row of held, a chunk of the items, with each request.

    A chunk meets all requests of a task one after the other: the rows of a request are a run, and the places of a
    chunk's items recur, which any codec folds up. This kind of join takes one pair after the other and needs no copy of
    the items in every task.
    """
    held, n, count = settle(held), items.count(), features.count()
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-count // ASKED))
    tasks = max(parts, min(held.count(), n * count // (TASK * groups)))
    asked = features.repartition(groups, F.xxhash64("request_id")).sortWithinPartitions("as_of", "request_id")
    return held.repartition(tasks).hint("shuffle_replicate_nl").join(asked)


def grid(features: DataFrame, items: DataFrame, plays: DataFrame, more: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """score of all candidates, a row for each request and item that it may be shown; features need the column variant.

    A chunk has items with the same genres, so their taste is worked out once for it and a request. In it, items that
    are alike in all that scores are made of have one score; only then the rows are made. more has further columns of a
    request's features and a list of genres, last has columns of these and the scores, all worked out as seldom.
    """
    features = settle(features)
    shown = plays.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("as_of", "plays", "popularity"))).alias("_plays"))
    alike = ["_plays", "quality", "freshness"]
    own = _chunks(_marked(features, items.select("item_id", "genres", "quality", "freshness").join(shown, "item_id", "left")), ["_seen", "genres"], alike)
    key = ["_chunk", "_seen", "genres"]
    cells = own.groupBy(*key, *alike).agg(F.sort_array(F.collect_list("item_id")).alias("_ids"))
    held = cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*alike, "_ids"))).alias("_cells"))
    rows = _met(held, features, items).withColumns({"_taste": taste(), **(more or {})})
    rows = rows.withColumn("_cell", F.explode("_cells")).withColumns({c: F.col("_cell")[c] for c in [*alike, "_ids"]})
    found = F.get(F.filter("_plays", lambda x: x["as_of"] == F.col("as_of")), F.lit(0))
    rows = scored(rows.withColumns({"plays": found["plays"], "popularity": found["popularity"]}), F.col("_taste")).withColumns(last or {})
    rows = rows.drop("_chunk", "_cells", "_cell", "_plays", "_taste", "genre_affinity")
    return rows.withColumn("item_id", F.explode("_ids")).filter(_open()).drop("_ids", "_seen", "recent_items")


def taste(genres: str = "genres", affinity: str = "genre_affinity") -> Column:
    """The mean affinity of an item's genres; a genre without affinity counts as 0."""
    total = F.aggregate(F.transform(F.col(genres), lambda g: F.coalesce(F.element_at(affinity, g), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.size(genres), F.lit(1))


def score(rows: DataFrame, plays: DataFrame) -> DataFrame:
    """Candidates with plays, retrieval_score and rank_score; rows need the column variant."""
    by = ["item_id"] if "as_of" not in plays.columns else ["as_of", "item_id"]
    return scored(rows.join(plays.select(*by, "plays", "popularity"), by, "left"))


def scored(rows: DataFrame, liking: Column | None = None) -> DataFrame:
    """Candidates that have plays and popularity (null: never played) with their scores; liking is their taste, if known.

    Users without any event are scored by quality and freshness in place of taste and popularity.
    """
    warm = S.TASTE_SHARE * (taste() if liking is None else liking) + S.POPULARITY_SHARE * F.coalesce("popularity", F.lit(0.0))
    rows = rows.withColumn("retrieval_score", F.when(F.col("event_count") == 0, _cold()).otherwise(warm))
    return rows.withColumn("plays", F.coalesce("plays", F.lit(0))).withColumn("rank_score", _blend(F.col("retrieval_score")))


def _cold() -> Column:
    return S.COLD_QUALITY * F.col("quality") + S.COLD_FRESHNESS * F.col("freshness")


def _blend(retrieval: Column) -> Column:
    """The rank score of an arm (the column variant)."""

    def of(weights) -> Column:
        r, q, f = weights
        base = r * retrieval + q * F.col("quality")
        return base + f * F.col("freshness") if f else base

    return F.when(F.col("variant") == "challenger", of(S.CHALLENGER)).otherwise(of(S.CONTROL))


#: Rank scores nearer than this may change places by rounding.
MARGIN = 1e-8


def shortlist(features: DataFrame, items: DataFrame, plays: DataFrame, k: int = S.SLATE) -> DataFrame:
    """The scored candidates that can be in a slate of k, which may be far fewer than all; none that can is missing.

    Of items with the same genres taste and penalty are the same for a request, whatever they are. So they differ only
    by a part of the score that depends on the point in time, the arm and whether the user is new, not on the request;
    at most the k best by it, behind those that the request leaves out, can be chosen. These few items for each list of
    genres meet the requests: the grid of users and items is never built.
    """
    known, kept = _short(features, items, plays, k)
    return scored(spread(known, "request_id").join(small(kept), KINDS).filter(~F.array_contains("recent_items", F.col("item_id"))).drop("cold"))


#: What a request and the part of an item's score that doesn't depend on its taste have in common.
KINDS = ["as_of", "variant", "cold"]


def _short(features: DataFrame, items: DataFrame, plays: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(features with the columns KINDS, the items that can be chosen for each of their kinds)."""
    most, kinds = k + S.RECENT, KINDS
    known = features.withColumn("cold", F.col("event_count") == 0)
    # A row for each point in time, arm and kind of user in the batch.
    wide = items.join(known.select(*kinds).distinct().hint("broadcast")).join(plays.select("as_of", "item_id", "plays", "popularity"), ["as_of", "item_id"], "left")
    part = _blend(F.when(F.col("cold"), _cold()).otherwise(S.POPULARITY_SHARE * F.coalesce("popularity", F.lit(0.0))))
    wide = wide.withColumn("part", part)
    group = [*kinds, "genres"]
    best = Window.partitionBy(*group).orderBy(F.desc("part"), "item_id")
    last = wide.select(*group, "item_id", "part").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most)
    least = last.filter(F.col("n") == most).select(*group, (F.col("part") - MARGIN).alias("least"))
    # Of items that are alike in this part, too, only the first by name can be chosen.
    alike = Window.partitionBy(*group, "part").orderBy("item_id")
    kept = wide.join(least, group, "left").filter("least is null or part >= least").withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= most)
    return known, kept.drop("part", "least", "n")


def half_up(x, places: int):
    """An array rounded as SQL does: halves of the decimal digits that a number shows go up."""
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np

    out, unit = np.round(x, places), Decimal(1).scaleb(-places)
    scaled = np.abs(x) * 10.0**places
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP))
    return out


def slates(features: DataFrame, items: DataFrame, plays: DataFrame, k: int = S.SLATE, penalty: float = S.DIVERSITY_PENALTY, places: int | None = None) -> DataFrame:
    """request_id, position, item_id, score: diverse_slate of the shortlist of every request, without listing it.

    Requests are dealt out to lanes of their kind, and each lane gets the items of its kind once. Taste is worked out
    for each list of genres, so a request costs some steps over the short items. places, if given, rounds rank scores.
    """
    known, kept = _short(features, items, plays, k)
    kept = settle(kept)
    lanes = 4 * int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*KINDS, "lane"]
    ask = known.select(*KINDS, F.pmod(F.xxhash64("request_id"), F.lit(lanes)).cast("int").alias("lane"), "request_id", F.map_keys("genre_affinity").alias("names"), F.map_values("genre_affinity").alias("values"), "recent_items")
    held = kept.select(*(F.col(c).alias(c) for c in KINDS), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "item_id", "genres", "quality", "freshness", F.coalesce("popularity", F.lit(0.0)).alias("popularity"))

    def run(ask, held):
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[], [], [], []]
        if ask.num_rows and held.num_rows:
            held = held.sort_by("item_id")  # so that the first of equals is the smaller item
            names, lists = held.column("item_id").to_pylist(), [tuple(g or ()) for g in held.column("genres").to_pylist()]
            place = {n: i for i, n in enumerate(names)}
            kinds = {g: i for i, g in enumerate(dict.fromkeys(lists))}
            genres = {g: i for i, g in enumerate(dict.fromkeys(x for g in kinds for x in g))}
            own = np.zeros((len(kinds), len(genres) + 1))
            steps = np.full((len(kinds), max([1, *map(len, kinds)])), len(genres))  # the last genre is none
            for g, i in kinds.items():
                for j, x in enumerate(g):
                    own[i, genres[x]] += 1
                    steps[i, j] = genres[x]
            each, kind = np.maximum(np.array([len(g) for g in kinds]), 1), np.array([kinds[g] for g in lists])
            quality, fresh, popular = (held.column(c).to_numpy() for c in ("quality", "freshness", "popularity"))
            cold, arm = held.column("cold")[0].as_py(), held.column("variant")[0].as_py()
            r, q, f = S.CHALLENGER if arm == "challenger" else S.CONTROL
            for request, keys, values, recent in zip(*(ask.column(c).to_pylist() for c in ("request_id", "names", "values", "recent_items")), strict=True):
                affinity = np.zeros(len(genres) + 1)
                for x, y in zip(keys or (), values or (), strict=True):
                    if x in genres:
                        affinity[genres[x]] = y
                taste = np.zeros(len(kinds))
                for j in range(steps.shape[1]):  # in the order of an item's genres
                    taste = taste + affinity[steps[:, j]]
                taste = taste / each
                retrieval = S.COLD_QUALITY * quality + S.COLD_FRESHNESS * fresh if cold else S.TASTE_SHARE * taste[kind] + S.POPULARITY_SHARE * popular
                rank = r * retrieval + q * quality
                rank = rank + f * fresh if f else rank
                rank = rank if places is None else half_up(rank, places)
                rank[[place[x] for x in recent or () if x in place]] = -np.inf
                count = np.zeros(len(genres) + 1)
                for p in range(k):
                    adjusted = rank - (penalty * ((own @ count) / each))[kind]
                    best = int(np.argmax(adjusted))
                    if adjusted[best] == -np.inf:
                        break
                    for column, value in zip(out, (request, p + 1, names[best], float(adjusted[best])), strict=True):
                        column.append(value)
                    rank[best] = -np.inf
                    count += own[kind[best]]
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["request_id", "position", "item_id", "score"])

    return ask.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(run, "request_id string, position int, item_id string, score double")


#: From where an item is fresh or popular enough to say so.
FRESH, TRENDING = 0.78, 2


def reasons(fresh: Column | None = None, trending: Column | None = None) -> Column:
    """At most two explanations of a candidate: the genre it matches, its freshness, its popularity; else its quality."""
    fresh = F.col("freshness") > FRESH if fresh is None else fresh
    trending = F.col("plays") > TRENDING if trending is None else trending
    order = F.sequence(F.lit(1), F.size("genres"))
    liked = F.transform(order, lambda i: F.struct(F.coalesce(F.element_at("genre_affinity", F.element_at("genres", i)), F.lit(0.0)).alias("a"), (-i).alias("i")))
    best = F.when(F.size("genres") > 0, F.array_max(liked))
    genre = F.element_at("genres", -best["i"])
    found = F.filter(
        F.array(
            F.when(best["a"] > 0, F.concat(F.lit("Matches your interest in "), genre)),
            F.when(fresh, F.lit("Fresh release")),
            F.when(trending, F.lit("Trending now")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(found) > 0, F.slice(found, 1, 2)).otherwise(F.array(F.lit("Highly rated for discovery")))


def top_k(rows: DataFrame, k: int = S.SLATE, score: str = "rank_score", per: str = "request_id", item: str = "item_id") -> DataFrame:
    """The k best rows for each request, ties to the smaller item, with `position` from 1."""
    best = Window.partitionBy(per).orderBy(F.desc(score), F.asc(item))
    return rows.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def diverse_slate(rows: DataFrame, k: int = S.SLATE, penalty: float = S.DIVERSITY_PENALTY) -> DataFrame:
    """request_id, position, item_id, score: greedy slates of scored candidates (request_id, item_id, genres, rank_score).

    Each place goes to the candidate whose rank score, less a penalty for genres that the slate already has, is
    highest; ties go to the smaller item. An item without genres has no penalty. The choice of a place depends on all
    places before, so a request's candidates come together; many requests share a batch of numpy work.
    """
    packed = rows.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "rank_score", "genres"))).alias("c"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            c = b.column("c")
            flat = c.flatten()
            cut = np.asarray(c.offsets) - c.offsets[0].as_py()
            rank, items = np.asarray(flat.field("rank_score")), flat.field("item_id")
            genres = flat.field("genres")
            lists = np.asarray(genres.offsets)
            first = lists[0]
            codes = genres.flatten().dictionary_encode()
            hot = np.zeros((len(rank), max(len(codes.dictionary), 1)))
            owner = np.repeat(np.arange(len(rank)), np.diff(lists))
            np.add.at(hot, (owner, np.asarray(codes.indices)[: lists[-1] - first]), 1.0)
            each = np.maximum(hot.sum(1), 1)
            request, place, chosen, scores = [], [], [], []
            for r in range(b.num_rows):
                i, j = int(cut[r]), int(cut[r + 1])
                own, count, free = hot[i:j], np.zeros(hot.shape[1]), np.ones(j - i, bool)
                for p in range(min(k, j - i)):
                    adjusted = np.where(free, rank[i:j] - penalty * ((own @ count) / each[i:j]), -np.inf)
                    best = int(np.argmax(adjusted))
                    free[best] = False
                    count += own[best]
                    request.append(r)
                    place.append(p + 1)
                    chosen.append(i + best)
                    scores.append(adjusted[best])
            yield pa.RecordBatch.from_arrays(
                [b.column("request_id").take(pa.array(request, pa.int64())), pa.array(place, pa.int32()), items.take(pa.array(chosen, pa.int64())), pa.array(scores, pa.float64())],
                names=["request_id", "position", "item_id", "score"],
            )

    return packed.mapInArrow(run, "request_id string, position int, item_id string, score double")


def recommend(requests: DataFrame, events: DataFrame, items: DataFrame, k: int = S.SLATE, salt: str = "ns", experiment: str = "ranker-v1", learned: DataFrame | None = None) -> DataFrame:
    """The slates of all requests: one row for each place, with item, scores, reasons, arm and serving mode.

    learned, if given, has request_id, item_id, retrieval_score and rank_score of the candidates that a model retrieved
    for the requests it serves; there these rows replace the heuristic scores and candidates.
    """
    # Settled: a row for each request, and for each item and point in time, that several steps below read.
    known = settle(user_features(requests, events, items).withColumns(assign(F.col("user_id"), experiment, salt)))
    plays = settle(popularity_scores(events, times_of(requests)))
    rest = known if learned is None else known.join(learned.select("request_id").distinct(), "request_id", "left_anti")
    chosen = settle(slates(rest, items, plays, k))
    rows = score(chosen.select("request_id", "item_id").join(known, "request_id").join(small(items), "item_id"), plays).withColumn("serving_mode", F.lit("heuristic"))
    if learned is not None:
        own = learned.select("request_id", "item_id", F.col("retrieval_score").alias("_r"), F.col("rank_score").alias("_k"))
        own = score(own.join(known, "request_id").join(small(items), "item_id"), plays).withColumns({"retrieval_score": F.col("_r"), "rank_score": F.col("_k")}).drop("_r", "_k")
        chosen = chosen.unionByName(diverse_slate(own.select("request_id", "item_id", "genres", "rank_score"), k))
        rows = rows.unionByName(own.withColumn("serving_mode", F.lit("learned_challenger")))
    rows = rows.withColumn("reasons", reasons())
    kept = ["request_id", "item_id", "user_id", "as_of", "title", "genres", "experiment", "variant", "bucket", "retrieval_score", "rank_score", "reasons", "serving_mode", "event_count"]
    return chosen.join(rows.select(kept), ["request_id", "item_id"])


def exposures(shown: DataFrame, model_version: str | None = None) -> DataFrame:
    """The exposure log of slates."""
    return shown.select(
        "request_id", "user_id", "item_id", "position", "experiment", "variant", "score", F.col("as_of").alias("timestamp"), F.lit(model_version).cast("string").alias("model_version"), "serving_mode"
    )
