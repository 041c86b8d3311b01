"""Every query of the engine by name, each with the SQL that checks it.

A query is a function of (spark, sf_dir) over whole tables. Its SQL is written apart from it, over the same views, and
gives the same columns. Computed doubles are rounded to nine places, where two engines' logarithms agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import schemas as S
from tidemark.functions import events as fn
from tidemark.ml import metrics, split as sp
from tidemark.operators import drift, experiments as ex, features as fe, ingest as ing, lake, latency, ranking as rk, serving, topk
from tidemark.plans import views as v
from tidemark.session import prepare
from tidemark.sources.tables import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PLACES = 9


def query(sql: str | None = None, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            ORACLE[f.__name__] = v.sql(sql, more)
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def rounded_doubles(*columns: str) -> dict[str, Column]:
    """The columns as rounded has them, for many rows."""
    return {c: fn.half_up(F.col(c), PLACES) for c in columns}


def requests_and_features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return v.requests(spark, sf), v.events(spark, sf), v.items(spark, sf)


def scored(spark: SparkSession, sf: str, only: str = "true", more: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """The scores of all candidates of the requests that `only` takes."""
    r, e, i = requests_and_features(spark, sf)
    known = fe.user_features(r, e, i).withColumns(ex.assign(F.col("user_id"))).filter(only)
    return rk.grid(known, i, fe.popularity_scores(e, rk.times_of(r)), more, last)


def shortlisted(spark: SparkSession, sf: str) -> DataFrame:
    """What of `scored` can be in a slate."""
    r, e, i = requests_and_features(spark, sf)
    known = fe.user_features(r, e, i).withColumns(ex.assign(F.col("user_id")))
    return rk.shortlist(known, i, fe.popularity_scores(e, rk.times_of(r)))


# Sources and scans


@query("SELECT item_id, title, array_to_string(genres, ',') AS genres, year, quality, freshness FROM v_items")
def catalogue_scan(spark, sf):
    return ing.scan_items(v.items(spark, sf)).select("item_id", "title", F.array_join("genres", ",").alias("genres"), "year", "quality", "freshness")


@query("SELECT item_id, title FROM v_items WHERE item_id = 'i000000042'")
def item_lookup(spark, sf):
    return ing.item(v.items(spark, sf), "i000000042").select("item_id", "title")


@query(f"SELECT event_id, user_id, item_id, action, timestamp, watch_pct FROM v_events WHERE timestamp <= {v.MIDDLE}")
def asof_filter(spark, sf):
    return ing.scan(v.events(spark, sf), as_of=v.MIDDLE, ordered=False).select(S.EVENT_COLUMNS)


@query("SELECT source_offset, event_id FROM v_log WHERE source_offset > 100 ORDER BY source_offset LIMIT 500")
def incremental_log(spark, sf):
    return ing.log(v.log(spark, sf), 100, 500).select("source_offset", "event_id")


@query("SELECT item_id, title, CASE WHEN year >= 2024 THEN 1.0::DOUBLE ELSE quality END AS quality FROM v_items")
def catalogue_upsert(spark, sf):
    i = v.items(spark, sf)
    return ing.put_items(i, i.filter("year >= 2024").withColumn("quality", F.lit(1.0))).select("item_id", "title", "quality")


@query("SELECT event_id, user_id, item_id, action FROM v_events WHERE action <> 'skip'")
def dedupe_ingest(spark, sf):
    e = v.events(spark, sf).drop("seq")
    fresh, _ = ing.ingest(e.filter("action = 'skip'"), e.unionByName(e))
    return fresh.select("event_id", "user_id", "item_id", "action")


@query("SELECT event_id FROM v_events WHERE action = 'like' AND watch_pct <> 0.5")
def conflict_detect(spark, sf):
    e = v.events(spark, sf).drop("seq")
    other = e.filter("action = 'like'").withColumn("watch_pct", F.lit(0.5))
    return ing.conflicts(e.unionByName(other)).select("event_id")


@query(
    """SELECT CASE WHEN event_type = 'error' THEN 'invalid action' WHEN value > 100 OR value < 0 THEN 'watch_pct must be between 0 and 1'
              ELSE 'valid' END AS reason, count(*) AS n FROM events GROUP BY ALL"""
)
def event_validation(spark, sf):
    e = v.events(spark, sf)
    raw = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), (F.col("value") / 100).cast("string").alias("raw_share"))
    rows = e.join(raw, "seq").drop("watch_pct").withColumnRenamed("raw_share", "watch_pct").withColumn("action", F.when(F.col("action") == "skip", "error").otherwise(F.col("action")))
    return rows.select(F.coalesce(ing.rejection(), F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT request_id, item_id, position, variant, timestamp FROM v_exposures WHERE variant = 'control'")
def exposure_append(spark, sf):
    x = v.exposures(spark, sf)
    return ing.record_exposures(x.filter("variant = 'challenger'"), x.unionByName(x)).select("request_id", "item_id", "position", "variant", "timestamp")


@query(
    """SELECT (SELECT count(*) FROM v_items) AS items, (SELECT count(*) FROM v_events) AS events,
              (SELECT count(DISTINCT user_id) FROM v_events) AS users, (SELECT count(*) FROM v_exposures) AS exposures"""
)
def store_stats(spark, sf):
    return ing.stats(v.items(spark, sf), v.events(spark, sf), v.exposures(spark, sf))


@query("SELECT request_id, item_id, position, timestamp FROM v_exposures")
def exposure_scan(spark, sf):
    x = v.exposures(spark, sf)
    other = x.limit(5).withColumn("experiment", F.lit("another"))
    return ing.scan_exposures(x.unionByName(other), "ranker-v1").select("request_id", "item_id", "position", "timestamp")


@query("SELECT event_id, item_id, action, timestamp FROM v_events WHERE user_id = (SELECT min(user_id) FROM v_events)")
def user_scan(spark, sf):
    e = v.events(spark, sf)
    return ing.scan(e, user_id=e.agg(F.min("user_id")).first()[0], ordered=False).select("event_id", "item_id", "action", "timestamp")


@query("SELECT event_id, user_id, item_id, action, timestamp, watch_pct FROM v_events WHERE action IN ('like', 'play')")
def jsonl_round_trip(spark, sf):
    """Events appended to a folder of JSON lines in two parts, and read back."""
    from tidemark.sources import jsonl
    from tidemark.sources.tables import work_dir

    path, e = work_dir(spark, "lines"), v.events(spark, sf).drop("seq")
    for action in ("like", "play"):
        jsonl.append(e.filter(F.col("action") == action), path)
    return jsonl.read(spark, path, S.EVENTS)


@query("SELECT count(*) AS events, 'none' AS missing FROM v_events")
def snapshot_round_trip(spark, sf):
    """A JSON snapshot written twice and read, and the default of one that isn't there."""
    from tidemark.sources import files
    from tidemark.sources.tables import work_dir

    path = work_dir(spark, "snapshot")
    for n in (0, v.events(spark, sf).count()):
        files.write_json(spark, f"{path}/state.json", {"events": n})
    return spark.createDataFrame([(files.read_json(spark, f"{path}/state.json")["events"], files.read_json(spark, f"{path}/other.json", "none"))], "events long, missing string")


@query("SELECT request_id, item_id, position, CAST(NULL AS VARCHAR) AS model_version, 'heuristic' AS serving_mode FROM v_exposures")
def schema_migration(spark, sf):
    """Exposures of before there were models, in today's columns."""
    return ing.add_missing(v.exposures(spark, sf), S.EXPOSURES).select("request_id", "item_id", "position", "model_version", "serving_mode")


@query(
    """SELECT round(1 / (1 + exp(-x)), 9) AS sigmoid, round(ln(1 + exp(-abs(x))) + greatest(x, 0), 9) AS softplus, count(*) AS n
       FROM (SELECT watch_pct * 40 - 20 AS x FROM v_events) GROUP BY ALL"""
)
def sigmoid_softplus(spark, sf):
    from tidemark.functions import events as fn

    x = v.events(spark, sf).select((F.col("watch_pct") * 40 - 20).alias("x"))
    return x.select(F.round(fn.sigmoid(F.col("x")), 9).alias("sigmoid"), F.round(fn.softplus(F.col("x")), 9).alias("softplus")).groupBy("sigmoid", "softplus").agg(F.count("*").alias("n"))


# Point-in-time features


@query("SELECT request_id, genre, CAST(weight AS DOUBLE) AS weight FROM v_sums")
def user_genre_affinity(spark, sf):
    r, e, i = requests_and_features(spark, sf)
    return fe.genre_weights(fe.visible(r, e), i).withColumn("weight", F.col("weight").cast("double"))


@query("SELECT request_id, genre, affinity FROM v_affinity")
def user_affinity_normalized(spark, sf):
    r, e, i = requests_and_features(spark, sf)
    return fe.affinities(fe.visible(r, e), i)


@query("SELECT request_id, string_agg(item_id, ',' ORDER BY rn DESC) AS recent_items FROM v_recent GROUP BY ALL")
def recent_items(spark, sf):
    r, e, i = requests_and_features(spark, sf)
    return fe.recent_items(fe.visible(r, e), i).withColumn("recent_items", F.array_join("recent_items", ","))


@query("SELECT request_id, event_count FROM v_counts")
def event_count(spark, sf):
    r, e, _ = requests_and_features(spark, sf)
    return fe.event_counts(fe.visible(r, e))


@query(
    """SELECT r.request_id, r.user_id, coalesce(n.event_count, 0) AS event_count,
              coalesce((SELECT count(*) FROM v_affinity a WHERE a.request_id = r.request_id), 0) AS genres,
              coalesce((SELECT count(*) FROM v_recent c WHERE c.request_id = r.request_id), 0) AS recent
       FROM v_requests r LEFT JOIN v_counts n USING (request_id)"""
)
def user_features(spark, sf):
    f = fe.user_features(*requests_and_features(spark, sf))
    return f.select("request_id", "user_id", "event_count", F.size("genre_affinity").cast("long").alias("genres"), F.size("recent_items").cast("long").alias("recent"))


@query("SELECT as_of, item_id, plays FROM v_plays")
def item_popularity(spark, sf):
    r, e, _ = requests_and_features(spark, sf)
    return fe.popularity(e, rk.times_of(r))


@query("SELECT as_of, item_id, plays, max_plays, round(popularity, 9) AS popularity FROM v_popularity")
def popularity_log_norm(spark, sf):
    r, e, _ = requests_and_features(spark, sf)
    return rounded(fe.popularity_scores(e, rk.times_of(r)), "popularity")


# Candidates, scores and slates


@query("SELECT request_id, item_id FROM v_candidates")
def candidates_anti_consumed(spark, sf):
    r, e, i = requests_and_features(spark, sf)
    return rk.candidates(fe.user_features(r, e, i), i.select("item_id")).select("request_id", "item_id")


@query("SELECT request_id, item_id, round(retrieval_score, 9) AS retrieval_score FROM v_scored WHERE event_count = 0")
def cold_start_scores(spark, sf):
    return scored(spark, sf, "event_count = 0", last=rounded_doubles("retrieval_score")).select("request_id", "item_id", "retrieval_score")


def _scores(variant: str) -> str:
    return f"SELECT request_id, item_id, plays, round(retrieval_score, 9) AS retrieval_score, round(rank_score, 9) AS rank_score FROM v_ranked WHERE variant = '{variant}'"


def _scored_arm(spark, sf, variant):
    rows = scored(spark, sf, f"variant = '{variant}'", last=rounded_doubles("retrieval_score", "rank_score"))
    return rows.select("request_id", "item_id", "plays", "retrieval_score", "rank_score")


@query(_scores("control"))
def heuristic_scores_control(spark, sf):
    return _scored_arm(spark, sf, "control")


@query(_scores("challenger"))
def heuristic_scores_challenger(spark, sf):
    return _scored_arm(spark, sf, "challenger")


@query(
    """SELECT request_id, CAST(position AS INTEGER) AS position, item_id, round(rank_score, 9) AS rank_score FROM (
         SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(rank_score, 9) DESC, item_id) AS position FROM v_ranked) WHERE position <= 12"""
)
def topk_slate(spark, sf):
    rows = rounded(shortlisted(spark, sf).select("request_id", "item_id", "rank_score"), "rank_score")
    return rk.top_k(rows).select("request_id", "position", "item_id", "rank_score")


def _slates(table: str) -> str:
    """The greedy choice as a recursion: each step takes the best of what is left, given the genres shown so far."""
    value = "c.rank_score - 0.075::DOUBLE * (list_sum(list_transform(c.genres, lambda g: len(list_filter(s.shown, lambda h: h = g)))) / len(c.genres))"
    return f"""v_step AS (
      SELECT request_id, 0 AS pos, []::VARCHAR[] AS chosen, []::VARCHAR[] AS shown, ''::VARCHAR AS item_id, 0.0::DOUBLE AS score FROM v_requests
      UNION ALL
      SELECT request_id, pos + 1, list_append(chosen, x.item_id), list_concat(shown, x.genres), x.item_id, x.score FROM (
        SELECT s.request_id, s.pos, s.chosen, s.shown, first({{'item_id': c.item_id, 'genres': c.genres, 'score': {value}}} ORDER BY {value} DESC, c.item_id) AS x
        FROM v_step s JOIN {table} c ON c.request_id = s.request_id AND NOT list_contains(s.chosen, c.item_id)
        WHERE s.pos < 12 GROUP BY s.request_id, s.pos, s.chosen, s.shown))"""


@query("SELECT request_id, pos AS position, item_id, round(score, 9) AS score FROM v_step WHERE pos > 0", "v_rounded AS (SELECT request_id, item_id, genres, round(rank_score, 9) AS rank_score FROM v_ranked), " + _slates("v_rounded"))
def greedy_slate(spark, sf):
    r, e, i = requests_and_features(spark, sf)
    known = fe.user_features(r, e, i).withColumns(ex.assign(F.col("user_id")))
    return rounded(rk.slates(known, i, fe.popularity_scores(e, rk.times_of(r)), places=PLACES), "score")


REASONS = """
v_best AS (
  SELECT request_id, item_id, genre, a FROM (
    SELECT c.request_id, c.item_id, g.genre, coalesce(f.affinity, 0) AS a,
           row_number() OVER (PARTITION BY c.request_id, c.item_id ORDER BY coalesce(f.affinity, 0) DESC, list_position(c.genres, g.genre)) AS n
    FROM v_candidates c JOIN v_genres g USING (item_id) LEFT JOIN v_affinity f ON f.request_id = c.request_id AND f.genre = g.genre) WHERE n = 1),
v_reasons AS (
  SELECT request_id, item_id, CASE WHEN reasons = '' THEN 'Highly rated for discovery' ELSE reasons END AS reasons FROM (
    SELECT s.request_id, s.item_id, array_to_string(list_filter([
        CASE WHEN b.a > 0 THEN 'Matches your interest in ' || b.genre END, CASE WHEN freshness > 0.78 THEN 'Fresh release' END,
        CASE WHEN plays > 2 THEN 'Trending now' END], lambda x: x IS NOT NULL)[1:2], '; ') AS reasons
    FROM v_scored s JOIN v_best b USING (request_id, item_id)))"""


@query("SELECT request_id, item_id, reasons FROM v_reasons", REASONS)
def reasons(spark, sf):
    each = F.array(*(F.array_join(rk.reasons(F.lit(fresh), F.lit(trending)), "; ") for fresh in (False, True) for trending in (False, True)))
    place = F.when(F.col("freshness") > rk.FRESH, 2).otherwise(0) + F.when(F.col("plays") > rk.TRENDING, 1).otherwise(0)
    return scored(spark, sf, more={"each": each}, last={"reasons": F.col("each")[place]}).select("request_id", "item_id", "reasons")


@query(
    """SELECT request_id, pos AS position, item_id, round(s.score, 9) AS score, round(retrieval_score, 9) AS retrieval_score, round(rank_score, 9) AS rank_score,
              reasons, variant, 'heuristic' AS serving_mode
       FROM v_step s JOIN v_ranked r USING (request_id, item_id) JOIN v_reasons USING (request_id, item_id) WHERE pos > 0""",
    f"{_slates('v_ranked')}, {REASONS}",
)
def recommendations(spark, sf):
    r, e, i = requests_and_features(spark, sf)
    rows = rk.recommend(r, e, i).select("request_id", "position", "item_id", "score", "retrieval_score", "rank_score", F.array_join("reasons", "; ").alias("reasons"), "variant", "serving_mode")
    return rounded(rows, "score", "retrieval_score", "rank_score")


# Experiments


@query("SELECT user_id, bucket, variant FROM v_arms")
def assignment_buckets(spark, sf):
    return v.events(spark, sf).select("user_id").distinct().withColumns(ex.assign(F.col("user_id"))).drop("experiment")


@query("SELECT variant, count(*) AS n FROM v_arms GROUP BY ALL")
def assignment_split(spark, sf):
    return assignment_buckets(spark, sf).groupBy("variant").agg(F.count("*").alias("n"))


EXPERIMENT = f"""
v_mature AS (SELECT request_id, arg_min(user_id, position) AS user_id, arg_min(variant, position) AS variant, arg_min(timestamp, position) AS ts
  FROM v_exposures WHERE timestamp + 604800.0 <= {v.READOUT} GROUP BY request_id),
v_good AS (SELECT * FROM v_events WHERE action IN ('like', 'complete') AND timestamp <= {v.READOUT}),
v_converted AS (SELECT DISTINCT m.request_id FROM v_mature m JOIN v_exposures x USING (request_id)
  JOIN v_good g ON g.user_id = m.user_id AND g.item_id = x.item_id AND g.timestamp > m.ts AND g.timestamp <= m.ts + 604800.0),
v_pre AS (SELECT m.request_id, count(g.event_id) AS pre_period FROM v_mature m LEFT JOIN v_good g
  ON g.user_id = m.user_id AND g.timestamp >= m.ts - 604800.0 AND g.timestamp < m.ts GROUP BY ALL),
v_obs AS (SELECT m.request_id, m.variant, CASE WHEN c.request_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS outcome, p.pre_period::DOUBLE AS pre_period
  FROM v_mature m LEFT JOIN v_converted c USING (request_id) JOIN v_pre p USING (request_id)),
v_theta AS (SELECT count(*) AS mature_requests, avg(pre_period) AS mean_x,
  CASE WHEN var_pop(pre_period) > 0 THEN covar_pop(outcome, pre_period) / var_pop(pre_period) ELSE 0 END AS theta FROM v_obs),
v_adjusted AS (SELECT variant, outcome, outcome - theta * (pre_period - mean_x) AS adjusted FROM v_obs, v_theta),
v_report AS (SELECT variant, count(*) AS requests, avg(outcome) AS conversion_rate, avg(adjusted) AS cuped_conversion_rate,
  sqrt(coalesce(var_samp(adjusted), 0) / count(*)) AS standard_error FROM v_adjusted GROUP BY ALL)"""


def _observations(spark, sf):
    return ex.observations(v.exposures(spark, sf), v.events(spark, sf), v.READOUT)


@query("SELECT request_id, user_id, variant, ts FROM v_mature", EXPERIMENT)
def mature_requests(spark, sf):
    return ex.mature_requests(v.exposures(spark, sf), v.READOUT)


@query("SELECT request_id, CAST(outcome AS INTEGER) AS converted FROM v_obs", EXPERIMENT)
def outcome_attribution(spark, sf):
    return ex.outcomes(v.exposures(spark, sf), v.events(spark, sf), v.READOUT)


@query("SELECT request_id, pre_period FROM v_pre", EXPERIMENT)
def pre_period_counts(spark, sf):
    return ex.pre_period_counts(v.exposures(spark, sf), v.events(spark, sf), v.READOUT)


@query("SELECT mature_requests, round(mean_x, 9) AS mean_x, round(theta, 9) AS theta FROM v_theta", EXPERIMENT)
def cuped_theta(spark, sf):
    return rounded(ex.theta(_observations(spark, sf)), "mean_x", "theta")


@query("SELECT variant, requests, round(conversion_rate, 9) AS conversion_rate, round(cuped_conversion_rate, 9) AS cuped_conversion_rate, round(standard_error, 9) AS standard_error FROM v_report", EXPERIMENT)
def cuped_variants(spark, sf):
    return rounded(ex.variants(_observations(spark, sf)).drop("theta"), "conversion_rate", "cuped_conversion_rate", "standard_error")


@query(
    """SELECT round(d, 9) AS absolute_lift, round(d / c.cuped_conversion_rate, 9) AS relative_lift, round(CASE WHEN se > 0 THEN d / se ELSE 0 END, 9) AS z_score,
              CASE WHEN least(c.requests, t.requests) >= 30 AND d < 0 AND d / se <= -2.576 THEN 'stop' ELSE 'continue' END AS sequential_guardrail,
              least(c.requests, t.requests) >= 30 AS minimum_sample_reached
       FROM v_report c, v_report t, LATERAL (SELECT t.cuped_conversion_rate - c.cuped_conversion_rate AS d, sqrt(c.standard_error ** 2 + t.standard_error ** 2) AS se) x
       WHERE c.variant = 'control' AND t.variant = 'challenger'""",
    EXPERIMENT,
)
def experiment_comparison(spark, sf):
    return rounded(ex.comparison(ex.variants(_observations(spark, sf))), "absolute_lift", "relative_lift", "z_score")


# The event-time lake

LAKE = f"""
v_marked AS (SELECT *, max(timestamp) OVER (ORDER BY source_offset ROWS UNBOUNDED PRECEDING) - {v.ALLOWED_LATENESS}.0 AS watermark FROM v_log),
v_gold AS (SELECT user_id, genre, CAST(round(sum(CAST(CAST(weight AS DECIMAL(24,12)) / n_genres AS DECIMAL(24,12))), 6) AS DOUBLE) AS affinity
  FROM v_weighted JOIN v_genres USING (item_id) GROUP BY ALL)"""


def _marked(spark, sf):
    return lake.running_watermark(v.log(spark, sf), v.ALLOWED_LATENESS)


@query("SELECT source_offset, event_id, round(watermark, 6) AS watermark FROM v_marked", LAKE)
def running_watermark(spark, sf):
    return _marked(spark, sf).select("source_offset", "event_id", F.round("watermark", 6).alias("watermark"))


@query("SELECT source_offset, event_id, round(watermark, 6) AS watermark, round(watermark - timestamp, 6) AS lateness_seconds FROM v_marked WHERE timestamp < watermark", LAKE)
def late_quarantine(spark, sf):
    return lake.split_late(_marked(spark, sf))[1].select("source_offset", "event_id", F.round("watermark", 6).alias("watermark"), "lateness_seconds")


@query("SELECT source_offset, event_id, false AS repaired FROM v_marked WHERE timestamp >= watermark", LAKE)
def silver_on_time(spark, sf):
    return lake.split_late(_marked(spark, sf))[0].select("source_offset", "event_id", "repaired")


@query("SELECT event_id, timestamp < watermark AS repaired FROM v_marked", LAKE)
def repair_union(spark, sf):
    silver, late = lake.split_late(_marked(spark, sf))
    return silver.unionByName(lake.repair(silver, late)).select("event_id", "repaired")


@query("SELECT user_id, genre, affinity FROM v_gold", LAKE)
def gold_affinity(spark, sf):
    return lake.gold(v.events(spark, sf), v.items(spark, sf))


@query("SELECT user_id, genre, affinity, 'missing' AS side FROM v_gold WHERE affinity < 0", LAKE)
def gold_verify_diff(spark, sf):
    """What replay finds that a snapshot without the negative affinities lacks."""
    g = lake.gold(v.events(spark, sf), v.items(spark, sf))
    return lake.differences(g, g.filter("affinity >= 0"))


@query("SELECT event_id, timestamp < watermark AS repaired FROM v_marked", LAKE)
def lake_run(spark, sf):
    """The lake itself, in four batches, repaired and verified: its silver table."""
    from tidemark.sources.tables import work_dir
    from tidemark.streaming.medallion import Medallion

    log = v.log(spark, sf)
    m = Medallion(spark, work_dir(spark, "lake"), v.items(spark, sf), v.ALLOWED_LATENESS)
    m.run_all(log, -(-log.count() // 4))
    m.repair_late()
    m.verify()
    return m.silver().select("event_id", "repaired")


def _medallion(spark, sf, batches: int):
    from tidemark.sources.tables import work_dir
    from tidemark.streaming.medallion import Medallion

    log = v.log(spark, sf)
    m = Medallion(spark, work_dir(spark, "lake"), v.items(spark, sf), v.ALLOWED_LATENESS)
    m.run_all(log, -(-log.count() // batches))
    return m


@query(
    """SELECT count(*) AS bronze_events, count(*) FILTER (timestamp >= watermark) AS silver_events, count(*) FILTER (timestamp < watermark) AS late_events,
              max(source_offset) AS source_offset, max(timestamp) AS max_event_time, max(timestamp) - 1728000.0::DOUBLE AS watermark FROM v_marked""",
    LAKE,
)
def lake_metrics(spark, sf):
    """Counts and the carry of the lake after two batches."""
    found = _medallion(spark, sf, 2).metrics()
    names = ["bronze_events", "silver_events", "late_events", "source_offset", "max_event_time", "watermark"]
    return spark.createDataFrame([tuple(found[n] for n in names)], "bronze_events long, silver_events long, late_events long, source_offset long, max_event_time double, watermark double")


@query("SELECT source_offset, event_id FROM v_log")
def lake_bronze(spark, sf):
    """Bronze after its last batch has come a second time."""
    m = _medallion(spark, sf, 2)
    m.process(v.log(spark, sf).filter("source_offset > 5"), m.carry()["batch"])
    return m.bronze().select("source_offset", "event_id")


@query(
    """SELECT sha256(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(a) AS VARCHAR), CAST(sum(b) AS VARCHAR), CAST(sum(c) AS VARCHAR), CAST(sum(d) AS VARCHAR))) AS sha256 FROM (
         SELECT ('0x' || substr(h, 1, 16))::UBIGINT AS a, ('0x' || substr(h, 17, 16))::UBIGINT AS b, ('0x' || substr(h, 33, 16))::UBIGINT AS c, ('0x' || substr(h, 49, 16))::UBIGINT AS d
         FROM (SELECT sha256(concat_ws(chr(9), user_id, genre, CAST(CAST(affinity AS DECIMAL(24,6)) AS VARCHAR))) AS h FROM v_gold))""",
    LAKE,
)
def gold_digest(spark, sf):
    return spark.createDataFrame([(lake.digest(lake.gold(v.events(spark, sf), v.items(spark, sf))),)], "sha256 string")


@query("SELECT event_id, user_id, item_id, action, round(timestamp, 3) AS timestamp, watch_pct FROM v_events WHERE action <> 'skip'")
def wire_parse(spark, sf):
    """Events through their wire form: JSON with RFC 3339 times, of which one action is made invalid."""
    from tidemark.streaming.kafka import parse_wire

    e = v.events(spark, sf)
    at = F.date_format(F.timestamp_micros(F.round(F.col("timestamp") * 1000000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), "event_id", "user_id", "item_id", F.when(F.col("action") == "skip", "jump").otherwise(F.col("action")).alias("action"), at.alias("event_time"), "watch_pct"))
    good, _ = parse_wire(e.select(body.alias("raw_json")))
    return good.select("event_id", "user_id", "item_id", "action", F.round(F.unix_micros("event_time") / 1000000.0, 3).alias("timestamp"), "watch_pct")


# Training data and metrics

SPLIT = """
v_pos AS (SELECT user_id, item_id, max(timestamp) AS ts FROM v_events JOIN v_items USING (item_id)
  WHERE action IN ('like', 'complete') OR (action = 'play' AND watch_pct >= 0.6) GROUP BY ALL),
v_split AS (SELECT user_id, item_id, ts, CASE rn WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS role,
    max(CASE WHEN rn = 3 THEN ts END) OVER (PARTITION BY user_id) AS cutoff
  FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn FROM v_pos) WHERE n >= 5),
v_tp AS (SELECT item_id, plays, ln(1 + plays) / max(ln(1 + plays)) OVER () AS popularity
  FROM (SELECT item_id, count(s.user_id) AS plays FROM v_items LEFT JOIN (SELECT * FROM v_split WHERE role = 'train') s USING (item_id) GROUP BY ALL)),
v_ig AS (SELECT item_id, genre, 1.0::DOUBLE / count(*) OVER (PARTITION BY item_id) AS weight FROM (SELECT DISTINCT item_id, genre FROM v_genres)),
v_tastes AS (SELECT user_id, genre, sum(weight) / max(n) AS taste FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM v_split WHERE role = 'train') s
  JOIN v_ig USING (item_id) GROUP BY ALL),
v_eval AS (SELECT u.user_id, i.item_id, i.item_id = t.item_id AS is_target FROM (SELECT DISTINCT user_id FROM v_split) u
  JOIN (SELECT * FROM v_split WHERE role = 'test') t USING (user_id), v_items i
  WHERE NOT EXISTS (SELECT 1 FROM v_split s WHERE s.user_id = u.user_id AND s.item_id = i.item_id AND s.role IN ('train', 'validation'))),
v_match AS (SELECT e.user_id, e.item_id, sum(coalesce(t.taste, 0)) / max(c.n) AS taste_match FROM v_eval e
  JOIN (SELECT item_id, genre, count(*) OVER (PARTITION BY item_id) AS n FROM v_ig) c USING (item_id)
  LEFT JOIN v_tastes t ON t.user_id = e.user_id AND t.genre = c.genre GROUP BY ALL),
v_models AS (
  SELECT 'popularity' AS model, user_id, item_id, is_target, round(popularity, 9) AS score FROM v_eval JOIN v_tp USING (item_id)
  UNION ALL
  SELECT 'heuristic', user_id, item_id, is_target, round(0.55::DOUBLE * taste_match + 0.25::DOUBLE * quality + 0.20::DOUBLE * freshness, 9)
  FROM v_eval JOIN v_match USING (user_id, item_id) JOIN v_items USING (item_id)),
v_ranks AS (SELECT *, row_number() OVER (PARTITION BY model, user_id ORDER BY score DESC, item_id) AS rank FROM v_models),
v_accuracy AS (SELECT model, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall,
  round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END), 9) AS ndcg, round(avg(1.0::DOUBLE / rank), 9) AS mrr FROM v_ranks WHERE is_target GROUP BY ALL)"""


def _split(spark, sf):
    return sp.temporal_split(v.events(spark, sf), v.items(spark, sf))


@query("SELECT user_id, item_id, ts FROM v_pos", SPLIT)
def positive_max_ts(spark, sf):
    return sp.positive_times(v.events(spark, sf), v.items(spark, sf))


@query("SELECT user_id, item_id, ts, role, cutoff FROM v_split", SPLIT)
def temporal_split(spark, sf):
    return _split(spark, sf)


@query("SELECT item_id, plays, round(popularity, 9) AS popularity FROM v_tp", SPLIT)
def train_popularity(spark, sf):
    return rounded(sp.train_popularity(_split(spark, sf), v.items(spark, sf)), "popularity")


@query("SELECT user_id, genre, round(taste, 9) AS taste FROM v_tastes", SPLIT)
def taste_vectors(spark, sf):
    return rounded(sp.taste_vectors(_split(spark, sf), v.items(spark, sf)), "taste")


@query(
    """SELECT DISTINCT e.user_id, e.item_id FROM v_events e JOIN (SELECT DISTINCT user_id, cutoff FROM v_split) c USING (user_id)
       WHERE timestamp <= cutoff AND (action IN ('skip', 'impression') OR (action = 'play' AND watch_pct < 0.4))
         AND NOT EXISTS (SELECT 1 FROM v_split s WHERE s.user_id = e.user_id AND s.item_id = e.item_id AND s.role = 'train')""",
    SPLIT,
)
def negative_labels(spark, sf):
    return sp.negatives(v.events(spark, sf), _split(spark, sf), v.items(spark, sf))


@query(
    """SELECT count(DISTINCT user_id) AS users, (SELECT count(*) FROM v_items) AS items, count(*) FILTER (role = 'train') AS train_interactions,
              count(*) FILTER (role = 'validation') AS validation_interactions, count(*) FILTER (role = 'test') AS test_interactions,
              min(cutoff) AS minimum_train_cutoff, max(cutoff) AS maximum_train_cutoff FROM v_split""",
    SPLIT,
)
def split_manifest(spark, sf):
    return sp.manifest(_split(spark, sf), v.items(spark, sf))


@query("SELECT user_id, item_id, is_target FROM v_eval", SPLIT)
def evaluation_candidates(spark, sf):
    return sp.evaluation_candidates(_split(spark, sf), v.items(spark, sf))


@query("SELECT * FROM v_accuracy WHERE model = 'popularity'", SPLIT)
def ranking_metrics_popularity(spark, sf):
    return rounded(metrics.accuracy(sp.baseline_places(_split(spark, sf), v.items(spark, sf), ("popularity",), PLACES)), "recall", "ndcg", "mrr")


@query("SELECT * FROM v_accuracy WHERE model = 'heuristic'", SPLIT)
def ranking_metrics_heuristic(spark, sf):
    return rounded(metrics.accuracy(sp.baseline_places(_split(spark, sf), v.items(spark, sf), ("heuristic",), PLACES)), "recall", "ndcg", "mrr")


@query(
    """SELECT model, round(coverage, 9) AS coverage, round(diversity, 9) AS diversity, round(novelty, 9) AS novelty FROM
         (SELECT model, count(DISTINCT item_id) / (SELECT count(*) FROM v_items)::DOUBLE AS coverage FROM v_ranks WHERE rank <= 5 GROUP BY ALL)
         JOIN (SELECT model, avg(d) AS diversity FROM (
            SELECT a.model, a.user_id, avg(1 - len(list_intersect(x.genres, y.genres)) / len(list_distinct(list_concat(x.genres, y.genres)))::DOUBLE) AS d
            FROM v_ranks a JOIN v_ranks b ON a.model = b.model AND a.user_id = b.user_id AND a.rank < b.rank AND b.rank <= 5
            JOIN v_items x ON x.item_id = a.item_id JOIN v_items y ON y.item_id = b.item_id GROUP BY ALL) GROUP BY ALL) USING (model)
         JOIN (SELECT model, avg(-log2((plays + 1) / ((SELECT sum(plays) FROM v_tp) + (SELECT count(*) FROM v_items))::DOUBLE)) AS novelty
            FROM v_ranks JOIN v_tp USING (item_id) WHERE rank <= 5 GROUP BY ALL) USING (model)""",
    SPLIT,
)
def coverage_diversity_novelty(spark, sf):
    s, i = settle(_split(spark, sf)), v.items(spark, sf)
    ranks = settle(sp.baseline_places(s, i, rounding=PLACES))
    return rounded(metrics.summary(ranks, s, i).drop("recall", "ndcg", "mrr"), "coverage", "diversity", "novelty")


#: Factors and weights of a model that is made up, so that SQL can follow what serving computes.
LEARNED = SPLIT + """,
v_users3 AS (SELECT user_id, [(n % 7) / 7.0::DOUBLE, (n % 11) / 11.0::DOUBLE, (n % 13) / 13.0::DOUBLE] AS v FROM (SELECT DISTINCT user_id, CAST(substr(user_id, 2) AS BIGINT) AS n FROM v_events)),
v_items3 AS (SELECT item_id, [(n % 5) / 5.0::DOUBLE, (n % 3) / 3.0::DOUBLE, (n % 17) / 17.0::DOUBLE] AS v, (n % 4) / 10.0::DOUBLE AS bias FROM (SELECT item_id, CAST(substr(item_id, 2) AS BIGINT) AS n FROM v_items)),
v_pair AS (SELECT user_id, item_id FROM v_split WHERE role = 'test'),
v_fit AS (SELECT p.user_id, p.item_id, sum(coalesce(t.taste, 0)) / max(c.n) AS taste_match FROM v_pair p
  JOIN (SELECT item_id, genre, count(*) OVER (PARTITION BY item_id) AS n FROM v_ig) c USING (item_id)
  LEFT JOIN v_tastes t ON t.user_id = p.user_id AND t.genre = c.genre GROUP BY ALL),
v_six AS (SELECT user_id, item_id, list_inner_product(u.v, i.v) + bias AS retrieval_score, quality, freshness, popularity, taste_match FROM v_fit
  JOIN v_users3 u USING (user_id) JOIN v_items3 i USING (item_id) JOIN v_items USING (item_id) JOIN v_tp USING (item_id)),
v_learned AS (SELECT *, 0.3::DOUBLE / (1 + exp(-(0.1 + 0.5 * (retrieval_score - 0.8) / 0.4 - 0.2 * (quality - 0.5) / 0.3 + 0.3 * (freshness - 0.5) / 0.3 + 0.4 * (popularity - 0.6) / 0.2
    + 0.7 * (taste_match - 0.1) / 0.1 + 0.25 * (quality * retrieval_score - 0.4) / 0.35))) + 0.7::DOUBLE * (0.55::DOUBLE * taste_match + 0.25::DOUBLE * quality + 0.20::DOUBLE * freshness) AS rank_score FROM v_six)"""


def _fixed_bundle(spark, sf):
    """The made-up model: its factors follow from the numbers in the names."""
    from tidemark.ml.ranker import Ranker
    from tidemark.ml.training import Bundle

    s, i = _split(spark, sf), v.items(spark, sf)
    n = lambda c: F.substring(c, 2, 20).cast("long")
    part = lambda c, *by: F.array(*((n(c) % b / F.lit(float(b))) for b in by))
    users = v.events(spark, sf).select("user_id").distinct().select("user_id", part("user_id", 7, 11, 13).alias("vector"))
    own = i.select("item_id", part("item_id", 5, 3, 17).alias("vector"), (n("item_id") % 4 / F.lit(10.0)).alias("bias"), "quality", "freshness", "genres").join(sp.train_popularity(s, i).select("item_id", "popularity"), "item_id")
    ranker = Ranker([0.5, -0.2, 0.3, 0.4, 0.7, 0.25], 0.1, [0.8, 0.5, 0.5, 0.6, 0.1, 0.4], [0.4, 0.3, 0.3, 0.2, 0.1, 0.35], 0.3)
    return Bundle("fixed", users, own, sp.taste_vectors(s, i), ranker), s


@query("SELECT user_id, item_id, round(retrieval_score, 9) AS retrieval_score, round(popularity, 9) AS popularity, round(taste_match, 9) AS taste_match, round(quality * retrieval_score, 9) AS quality_x_retrieval FROM v_six", LEARNED)
def learned_features(spark, sf):
    from tidemark.ml import ranker

    model, s = _fixed_bundle(spark, sf)
    rows = ranker.features(s.filter("role = 'test'").select("user_id", "item_id"), model.users, model.items, model.tastes)
    return rounded(rows.select("user_id", "item_id", "retrieval_score", "popularity", "taste_match", "quality_x_retrieval"), "retrieval_score", "popularity", "taste_match", "quality_x_retrieval")


@query("SELECT user_id, item_id, round(retrieval_score, 9) AS retrieval_score, round(rank_score, 9) AS rank_score FROM v_learned", LEARNED)
def learned_scores(spark, sf):
    """The model's scores after it has been saved and loaded."""
    from tidemark.ml.training import Bundle
    from tidemark.sources.tables import work_dir

    model, s = _fixed_bundle(spark, sf)
    path = work_dir(spark, "bundle")
    model.save(path)
    rows = Bundle.load(spark, path).scores(s.filter("role = 'test'").select("user_id", "item_id"))
    return rounded(rows, "retrieval_score", "rank_score")


@query(
    """SELECT request_id, item_id FROM (
         SELECT r.request_id, i.item_id, row_number() OVER (PARTITION BY r.request_id ORDER BY round(list_inner_product(u.v, i.v) + bias, 10) DESC, i.item_id) AS rank
         FROM v_requests r JOIN v_users3 u USING (user_id), v_items3 i
         WHERE NOT EXISTS (SELECT 1 FROM v_recent c WHERE c.request_id = r.request_id AND c.item_id = i.item_id)) WHERE rank <= 20""",
    LEARNED,
)
def learned_retrieval(spark, sf):
    """The 20 items that the model's towers put first for each request, without its recent ones."""
    from tidemark.runtime import Runtime

    r, e, i = requests_and_features(spark, sf)
    return Runtime(_fixed_bundle(spark, sf)[0]).retrieve(fe.user_features(r, e, i), i, 20)


@query()
def four_way_evaluation(spark, sf):
    """Popularity, heuristic, two-tower retrieval and the learned ranker on the test items, after training."""
    from tidemark.ml import training

    return training.train(v.events(spark, sf), v.items(spark, sf)).evaluation


# Retrieval, drift, serving


def _vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = F.col("embedding").cast("array<double>")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), x.alias("q")), e.select(F.col("vec_id").alias("item_id"), x.alias("v"), F.coalesce(F.col("label") / 1000.0, F.lit(0.0)).alias("bias"))


@query(
    """SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
         SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) + coalesce(i.label / 1000.0::DOUBLE, 0), 10) AS score
         FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0)) WHERE rank <= 10"""
)
def exact_mips_topk(spark, sf):
    return topk.exact_top_k(*_vectors(spark, sf), 10)


@query()
def ann_recall(spark, sf):
    q, i = _vectors(spark, sf)
    return topk.recall(topk.approximate_top_k(q, i, 10), topk.exact_top_k(q, i, 10), 10)


@query(
    """SELECT round(sum(0.5 * p * log2(p / m) + 0.5 * q * log2(q / m)), 9) AS js FROM (SELECT *, (p + q) / 2 AS m FROM (
         SELECT (popularity + 1e-12) / sum(popularity + 1e-12) OVER () AS p, (live + 1e-12) / sum(live + 1e-12) OVER () AS q
         FROM v_tp JOIN (SELECT item_id, count(event_id)::DOUBLE AS live FROM v_items LEFT JOIN v_events USING (item_id) GROUP BY ALL) USING (item_id)))""",
    SPLIT,
)
def drift_js(spark, sf):
    trained = sp.train_popularity(_split(spark, sf), v.items(spark, sf))
    cells = trained.join(drift.live_counts(v.events(spark, sf), trained), "item_id")
    return rounded(drift.jensen_shannon(cells, "popularity", "live"), "js")


@query("SELECT action, count(*) AS n FROM v_events GROUP BY ALL")
def action_mix(spark, sf):
    return drift.action_counts(v.events(spark, sf))


@query(
    """SELECT request_id, CASE WHEN variant <> 'challenger' THEN 'heuristic_control' WHEN NOT known THEN 'heuristic_fallback' ELSE 'learned_challenger' END AS mode,
              CASE WHEN variant = 'challenger' AND NOT known THEN 'unknown user' END AS fallback_reason
       FROM (SELECT request_id, variant, EXISTS (SELECT 1 FROM v_good g WHERE g.user_id = r.user_id) AS known FROM v_requests r JOIN v_arms USING (user_id))""",
    f"v_good AS (SELECT DISTINCT user_id FROM v_events WHERE action = 'like' AND timestamp <= {v.MIDDLE})",
)
def serving_decisions(spark, sf):
    """Decisions with a model that knows the users who had liked something by the middle of the month."""
    r, e, i = requests_and_features(spark, sf)
    known = e.filter((F.col("action") == "like") & (F.col("timestamp") <= v.MIDDLE)).select("user_id").distinct()
    rows = serving.decide(r.withColumns(ex.assign(F.col("user_id"))), serving.Loaded("v1", known, i.select("item_id")), i)
    return rows.select("request_id", "mode", "fallback_reason")


@query(
    """SELECT mode, count(*) AS n FROM (SELECT CASE WHEN variant <> 'challenger' THEN 'heuristic_control' WHEN NOT known THEN 'heuristic_fallback' ELSE 'learned_challenger' END AS mode
       FROM (SELECT request_id, variant, EXISTS (SELECT 1 FROM v_good g WHERE g.user_id = r.user_id) AS known FROM v_requests r JOIN v_arms USING (user_id))) GROUP BY ALL""",
    f"v_good AS (SELECT DISTINCT user_id FROM v_events WHERE action = 'like' AND timestamp <= {v.MIDDLE})",
)
def serving_modes(spark, sf):
    return latency.by_mode(serving_decisions(spark, sf))


@query("SELECT true AS same, (SELECT count(*) FROM v_items WHERE quality >= 0.5) = (SELECT count(*) FROM v_items) AS part")
def catalogue_equality(spark, sf):
    i = v.items(spark, sf)
    return spark.createDataFrame([(serving.same_catalogue(i, i.orderBy("title")), serving.same_catalogue(i.filter("quality >= 0.5"), i))], "same boolean, part boolean")


BUCKETS = ", ".join(f"({b}::DOUBLE)" for b in S.LATENCY_BUCKETS)


@query(f"SELECT le, (SELECT count(*) FROM events WHERE value / 1000.0::DOUBLE <= le) AS count FROM (VALUES {BUCKETS}, ('infinity'::DOUBLE)) t(le)")
def latency_histogram(spark, sf):
    return latency.histogram(spark.read.parquet(f"{sf}/events.parquet").select((F.col("value") / 1000.0).alias("latency_seconds")))


@query(
    """SELECT round(avg(value), 6) AS mean, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.5, 0) AS INTEGER) + 1] AS p50,
              list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INTEGER) + 1] AS p95,
              list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.99, 0) AS INTEGER) + 1] AS p99, max(value) AS max FROM events"""
)
def nearest_rank_percentiles(spark, sf):
    return latency.nearest_rank(spark.read.parquet(f"{sf}/events.parquet"), "value").withColumn("mean", F.round("mean", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
