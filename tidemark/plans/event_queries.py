"""Event histories: sessions, runs, strays, rollups, time windows, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, sessions
from ..sources.tables import insert_ignore, table
from .registry import query

GAP = 6 * 3600
_ISLANDS = """isl AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""
_SESSIONS = _ISLANDS + """, ses AS (SELECT user_id, CAST(island AS BIGINT) AS island, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS listen_count, count(DISTINCT event_type) AS tracks_played FROM isl GROUP BY user_id, island),
full_ses AS (SELECT *, floor((2000 * tracks_played + 5) / 10) / 1000 AS completion,
  CASE WHEN tracks_played / 5.0 >= 0.8 THEN 'full' WHEN tracks_played / 5.0 >= 0.25 AND tracks_played >= 3 THEN 'partial' ELSE 'none' END AS session_type FROM ses)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type", GAP, 5)


@query("WITH " + _SESSIONS + " SELECT user_id, island, started_at, ended_at, listen_count, tracks_played, completion, session_type FROM full_ses")
def album_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir)


@query("WITH " + _SESSIONS + """ SELECT user_id, count(*) AS sessions, count(*) FILTER (session_type = 'full') AS full_sessions, count(*) FILTER (session_type = 'partial') AS partial_sessions,
  max(completion) AS best_completion, CAST(sum(listen_count) AS BIGINT) AS listens, min(started_at) AS first_at, max(ended_at) AS last_at FROM full_ses GROUP BY user_id""")
def sessions_rollup(spark, sf_dir):
    return sessions.sessions_rollup(_sessions(spark, sf_dir), ["user_id"])


@query("""WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM x)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n, count(DISTINCT props) AS titles FROM i GROUP BY user_id, island, event_type HAVING count(DISTINCT props) >= 2""")
def runs_gap_islands(spark, sf_dir):
    return sessions.runs(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type", F.col("props"), 86_400, 2)


_STRAYS = """st AS (SELECT * FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 28800000000 AND epoch_us(lead(ts) OVER w) - epoch_us(ts) < 28800000000
  AND lag(event_type) OVER w = lead(event_type) OVER w AND lag(event_type) OVER w <> event_type THEN lag(event_type) OVER w END AS home FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE home IS NOT NULL)"""


@query("WITH " + _STRAYS + " SELECT event_id, user_id, event_type, home FROM st")
def stray_events(spark, sf_dir):
    found = sessions.strays(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type", 8 * 3600)
    return found.select("event_id", "user_id", "event_type", "home")


@query("WITH " + _STRAYS + """ SELECT user_id, event_type, home, evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY evidence DESC, home) AS r
  FROM (SELECT user_id, event_type, home, count(*) AS evidence FROM st GROUP BY ALL)) WHERE r = 1""")
def stray_redirects(spark, sf_dir):
    found = sessions.strays(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type", 8 * 3600)
    return sessions.learn_redirects(found, "user_id", "event_type")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (f) AS flips FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 AND lag(event_type) OVER w <> event_type AS f
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id""")
def run_flips(spark, sf_dir):
    return sessions.flips(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type", GAP)


@query("WITH " + _ISLANDS + """, s AS (SELECT user_id // 2 AS pair, min(event_id) AS sid, min(ts) AS a, max(ts) AS b FROM isl GROUP BY user_id, island)
SELECT x.pair, x.sid AS first_id, y.sid AS second_id FROM s x JOIN s y ON x.pair = y.pair AND x.sid < y.sid AND x.a <= y.b AND y.a <= x.b""")
def overlapping_intervals(spark, sf_dir):
    islands = sessions.gap_islands(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", GAP)
    spans = islands.groupBy("user_id", "island").agg(F.min("event_id").alias("sid"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return sessions.overlapping(spans.withColumn("pair", F.expr("user_id div 2")), ["pair"], "sid", "a", "b")


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, count(DISTINCT (user_id, event_type)) AS pairs, min(ts) AS first_at, max(ts) AS last_at
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'""")
def summary_window(spark, sf_dir):
    df = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ'2024-01-10 00:00:00' and ts < TIMESTAMP_NTZ'2024-01-21 00:00:00'")
    return df.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.countDistinct(F.struct("user_id", "event_type")).alias("pairs"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def timeline_by_period(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date").alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def dedup_natural_key(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return relational.first_per(df, ["user_id", "event_type", "hour"], F.asc("event_id")).select("event_id", "user_id", "event_type", "ts")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_id % 3 = 0) WHERE r = 1
UNION ALL SELECT user_id, event_type, min(event_id) FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 3 = 0 AND x.user_id = e.user_id AND x.event_type = e.event_type) GROUP BY ALL""")
def insert_ignore_on_key(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    least = lambda d: d.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return insert_ignore(least(df.where("event_id % 3 = 0")), least(df), ["user_id", "event_type"])


_MINUTES = """up AS (SELECT date_trunc('minute', ts) AS minute, event_type AS title FROM events), st AS (SELECT date_trunc('minute', ts) AS minute, event_type AS title FROM events WHERE event_id % 17 <> 0
  UNION ALL SELECT date_trunc('minute', ts), CASE WHEN event_id % 2 = 0 THEN 'other' ELSE event_type END FROM events WHERE event_id % 23 = 0),
j AS (SELECT coalesce(a.minute, b.minute) AS minute, coalesce(u, 0) AS u, coalesce(s, 0) AS s FROM (SELECT minute, title, count(*) AS u FROM up GROUP BY ALL) a FULL JOIN (SELECT minute, title, count(*) AS s FROM st GROUP BY ALL) b ON a.minute = b.minute AND a.title = b.title),
k AS (SELECT minute, CAST(sum(u) AS BIGINT) AS u, CAST(sum(s) AS BIGINT) AS s, CAST(sum(CASE WHEN u = 0 THEN s ELSE 0 END) AS BIGINT) AS un FROM j GROUP BY minute)"""


@query("WITH " + _MINUTES + " SELECT minute, greatest(s - u, 0) AS surplus, greatest(u - s, 0) AS missing, s > u AND s - u <> un AS ambiguous FROM k")
def reconcile_minutes(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("minute"), F.col("event_type").alias("title"))
    twice = df.where("event_id % 23 = 0").withColumn("title", F.when(F.col("event_id") % 2 == 0, "other").otherwise(F.col("title")))
    return relational.reconcile(df, df.where("event_id % 17 <> 0").unionByName(twice), "minute", "title", "event_id")


@query("""SELECT user_id AS touched, 'event' AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-29' UNION SELECT o_custkey, 'order' FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01' UNION SELECT c_custkey, 'customer' FROM customer WHERE c_acctbal < 0""")
def changed_groups(spark, sf_dir):
    recent = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ'2024-01-29 00:00:00'").select(F.col("user_id").alias("touched"), F.lit("event").alias("kind"))
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ'2001-06-01 00:00:00'").select("o_custkey", F.lit("order"))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", F.lit("customer"))
    return recent.union(orders).union(poor).distinct()


@query("""SELECT * FROM (SELECT event_id, ts, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY)""")
def watermark_overlap_scan(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    last = df.agg(F.max("ts").alias("last"))
    return df.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 3 DAYS")).drop("last")  # one row is broadcast


@query("""SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean_value, CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS bought FROM events GROUP BY user_id HAVING count(*) > 50""")
def heavy_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.max((F.col("event_type") == "purchase").cast("int")).alias("bought")).where("n > 50")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') IS NOT NULL AS has_missing FROM events""")
def json_unnest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("has_missing"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS at_epoch, CAST(date_trunc('week', ts - INTERVAL 6 HOUR) AS DATE) AS local_week, CAST(floor(year(ts) / 10) * 10 AS INTEGER) AS decade,
round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0, 5) AS days_ago FROM events""")
def date_functions(spark, sf_dir):
    """Chicago is six hours behind UTC in all of these events."""
    at = F.col("ts").cast("timestamp")
    week = F.date_trunc("week", F.from_utc_timestamp(at, "America/Chicago")).cast("date")
    days = (F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(at)) / 86_400e6
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(at).alias("at_epoch"), week.alias("local_week"), (F.floor(F.year("ts") / 10) * 10).cast("int").alias("decade"), F.round(days, 5).alias("days_ago"))


@query("""WITH h AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS fulls, count(*) AS listens, max(ts) AS last_at FROM events GROUP BY user_id),
d AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_at)) / 86400000000.0 AS idle FROM h)
SELECT user_id, CASE WHEN fulls >= 1 AND idle >= CASE WHEN fulls >= 18 THEN 5 WHEN fulls >= 12 THEN 3 ELSE 2 END THEN 'spaced' WHEN (fulls >= 15 OR listens >= 80) AND idle >= 1 THEN 'abandoned' WHEN fulls < 10 AND idle >= 1.5 THEN 'unfinished' END AS pool, round(idle, 5) AS idle_days FROM d""")
def revisit_pools(spark, sf_dir):
    """The first pool that fits: spaced, abandoned or unfinished. An album not yet due for one can still fit a later one."""
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("fulls"), F.count("*").alias("listens"), F.max("ts").alias("last_at"))
    idle = (F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 86_400e6
    wait = F.when(F.col("fulls") >= 18, 5).when(F.col("fulls") >= 12, 3).otherwise(2)
    pool = F.when((F.col("fulls") >= 1) & (idle >= wait), "spaced").when(((F.col("fulls") >= 15) | (F.col("listens") >= 80)) & (idle >= 1), "abandoned").when((F.col("fulls") < 10) & (idle >= 1.5), "unfinished")
    return h.select("user_id", pool.alias("pool"), F.round(idle, 5).alias("idle_days"))
