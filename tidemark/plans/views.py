"""The engine's tables over the star-schema test tables, in Spark and as the same SQL for DuckDB.

part gives the catalogue, events the viewing events and exposures; the SQL is what the queries are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.experiments import assign

#: Points in time of the requests: before the first event, and in the middle of the month.
EARLY, MIDDLE = 1704067200.0, 1705363200.0
#: When the readout is taken, in seconds since the epoch.
READOUT = 1706659200.0
ALLOWED_LATENESS = 20 * 86400
#: Events name this many items, the first ones of the catalogue; it has all parts.
SEEN = 100
DIGITS = 9


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item(key) -> F.Column:
    return F.concat(F.lit("i"), F.lpad(key.cast("string"), DIGITS, "0"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        _item(key).alias("item_id"),
        F.col("p_name").alias("title"),
        F.split("p_name", " ").alias("genres"),
        (2021 + key % 6).cast("int").alias("year"),
        (F.col("p_size") / 50.0).alias("quality"),
        (((key * 37) % 100) / 100.0).alias("freshness"),
        F.lit("#6957ff").alias("color"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.create_map(*(F.lit(x) for pair in (("view", "impression"), ("click", "play"), ("purchase", "complete"), ("signup", "like"), ("error", "skip")) for x in pair))
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("event_id"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("user_id"),
        _item(F.get_json_object("props", "$.k").cast("int")).alias("item_id"),
        F.element_at(action, F.col("event_type")).alias("action"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("timestamp"),
        (F.least(F.col("value"), F.lit(100.0)) / 100.0).alias("watch_pct"),
        F.col("event_id").alias("seq"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in an order of arrival that isn't that of their times: 7919 has no factor in common with powers of 10."""
    e = events(spark, sf_dir)
    n = _read(spark, sf_dir, "events").count()
    return e.withColumn("source_offset", (F.col("seq") * 7919) % n + 1).drop("seq")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = events(spark, sf_dir).select("user_id").distinct()
    times = F.explode(F.array(F.lit(EARLY), F.lit(MIDDLE)))
    return users.withColumn("as_of", times).select(F.concat("user_id", F.lit("@"), F.col("as_of").cast("long").cast("string")).alias("request_id"), "user_id", "as_of")


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = events(spark, sf_dir).filter("action = 'impression'").withColumns(assign(F.col("user_id")))
    place = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: _item(((F.substring("item_id", 2, DIGITS).cast("int") + i) % SEEN))))
    rows = shown.select(F.col("event_id").alias("request_id"), "user_id", "experiment", "variant", "timestamp", place.alias("p", "item_id"))
    return rows.select("request_id", "user_id", "item_id", (F.col("p") + 1).cast("int").alias("position"), "experiment", "variant", F.lit(0.0).alias("score"), "timestamp")


SQL = f"""
v_items AS (
  SELECT 'i' || lpad(CAST(p_partkey AS VARCHAR), {DIGITS}, '0') AS item_id, p_name AS title, string_split(p_name, ' ') AS genres,
         CAST(2021 + p_partkey % 6 AS INTEGER) AS year, p_size / 50.0::DOUBLE AS quality, ((p_partkey * 37) % 100) / 100.0::DOUBLE AS freshness
  FROM part),
v_genres AS (SELECT item_id, len(genres) AS n_genres, unnest(genres) AS genre FROM v_items),
v_events AS (
  SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id, 'u' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS user_id,
         'i' || lpad(json_extract_string(props, '$.k'), {DIGITS}, '0') AS item_id,
         CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'play' WHEN 'purchase' THEN 'complete'
                         WHEN 'signup' THEN 'like' WHEN 'error' THEN 'skip' END AS action,
         epoch_us(ts) / 1000000.0::DOUBLE AS timestamp, least(value, 100.0::DOUBLE) / 100.0::DOUBLE AS watch_pct, event_id AS seq
  FROM events),
v_weighted AS (
  SELECT *, CASE action WHEN 'impression' THEN 0 WHEN 'like' THEN 3.0 WHEN 'skip' THEN -2.5
                        WHEN 'play' THEN 0.8 * greatest(0.15, CAST(watch_pct AS DECIMAL(9,4)))
                        WHEN 'complete' THEN 2.2 * greatest(0.15, CAST(watch_pct AS DECIMAL(9,4))) END::DECIMAL(18,6) AS weight
  FROM v_events),
v_log AS (SELECT *, (seq * 7919) % (SELECT count(*) FROM events) + 1 AS source_offset FROM v_events),
v_requests AS (
  SELECT user_id || '@' || CAST(CAST(as_of AS BIGINT) AS VARCHAR) AS request_id, user_id, as_of
  FROM (SELECT DISTINCT user_id FROM v_events) u, (VALUES ({EARLY}::DOUBLE), ({MIDDLE}::DOUBLE)) t(as_of)),
v_assigned AS (
  SELECT user_id, CAST(('0x' || substr(sha256('ns:ranker-v1:' || user_id), 1, 16))::UBIGINT % 10000 AS INTEGER) AS bucket
  FROM (SELECT DISTINCT user_id FROM v_events) u),
v_arms AS (SELECT *, CASE WHEN bucket < 5000 THEN 'challenger' ELSE 'control' END AS variant FROM v_assigned),
v_exposures AS (
  SELECT event_id AS request_id, user_id, 'i' || lpad(CAST((CAST(substr(item_id, 2, {DIGITS}) AS INTEGER) + p) % {SEEN} AS VARCHAR), {DIGITS}, '0') AS item_id,
         CAST(p + 1 AS INTEGER) AS position, variant, timestamp
  FROM v_events JOIN v_arms USING (user_id), (VALUES (0), (1), (2)) t(p) WHERE action = 'impression'),
v_seen AS (SELECT r.request_id, r.as_of, e.* FROM v_requests r JOIN v_weighted e ON e.user_id = r.user_id AND e.timestamp <= r.as_of),
v_sums AS (
  SELECT request_id, genre, sum(CAST(CAST(weight AS DECIMAL(24,12)) / n_genres AS DECIMAL(24,12))) AS weight
  FROM v_seen JOIN v_genres USING (item_id) GROUP BY ALL),
v_affinity AS (
  SELECT request_id, genre, round(CAST(weight AS DOUBLE) / greatest(CAST(sum(abs(weight)) OVER (PARTITION BY request_id) AS DOUBLE), 1.0), 6) AS affinity
  FROM v_sums),
v_counts AS (SELECT request_id, count(*) AS event_count FROM v_seen GROUP BY ALL),
v_recent AS (
  SELECT request_id, item_id, rn FROM (
    SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY timestamp DESC, event_id DESC) AS rn
    FROM v_seen WHERE action <> 'impression' AND item_id IN (SELECT item_id FROM v_items)) WHERE rn <= 12),
v_plays AS (
  SELECT as_of, item_id, count(*) AS plays FROM v_events, (SELECT DISTINCT as_of FROM v_requests) t
  WHERE timestamp <= as_of AND action IN ('play', 'complete', 'like') GROUP BY ALL),
v_popularity AS (SELECT *, max(plays) OVER (PARTITION BY as_of) AS max_plays, ln(1 + plays) / ln(1 + max(plays) OVER (PARTITION BY as_of)) AS popularity FROM v_plays),
v_candidates AS (
  SELECT r.request_id, r.user_id, r.as_of, i.* FROM v_requests r, v_items i
  WHERE NOT EXISTS (SELECT 1 FROM v_recent c WHERE c.request_id = r.request_id AND c.item_id = i.item_id)),
v_taste AS (
  SELECT c.request_id, c.item_id, sum(coalesce(a.affinity, 0)) / max(g.n_genres) AS taste
  FROM v_candidates c JOIN v_genres g USING (item_id) LEFT JOIN v_affinity a ON a.request_id = c.request_id AND a.genre = g.genre GROUP BY ALL),
v_scored AS (
  SELECT c.*, a.variant, coalesce(n.event_count, 0) AS event_count, coalesce(p.plays, 0) AS plays,
         CASE WHEN coalesce(n.event_count, 0) = 0 THEN 0.65::DOUBLE * quality + 0.35::DOUBLE * freshness
              ELSE 0.70::DOUBLE * taste + 0.30::DOUBLE * coalesce(p.popularity, 0) END AS retrieval_score
  FROM v_candidates c JOIN v_taste USING (request_id, item_id) JOIN v_arms a USING (user_id) LEFT JOIN v_counts n USING (request_id)
       LEFT JOIN v_popularity p USING (as_of, item_id)),
v_ranked AS (
  SELECT *, CASE WHEN variant = 'challenger' THEN 0.55::DOUBLE * retrieval_score + 0.27::DOUBLE * quality + 0.18::DOUBLE * freshness
                 ELSE 0.62::DOUBLE * retrieval_score + 0.38::DOUBLE * quality END AS rank_score FROM v_scored)
"""


def sql(select: str, more: str = "") -> str:
    """A query over the views; `more` has further common table expressions."""
    return f"WITH RECURSIVE {SQL.strip()}{', ' + more if more else ''} {select}"
