"""Event streams, driven to their end over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sessions import gap_islands
from ..sources.tables import shared_folder, table
from ..streaming import catchup, leases
from ..streaming import events as streams
from .registry import query


def _stream(spark, sf_dir):
    return streams.read_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")


@query("SELECT user_id, event_type, ts FROM events GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    found = streams.run_to_end(streams.dedup(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type", "ts"]))
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM x),
m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), z AS (SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n FROM y GROUP BY user_id, k) SELECT z.* FROM z, m WHERE ended_at + INTERVAL 6 HOUR <= mark""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed, equal to the batch job's up to then."""
    found = streams.run_to_end(streams.sessions(_stream(spark, sf_dir), "user_id", "6 hours", "1 day"))
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")), "n")


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day FROM events), w AS (SELECT event_type, unnest([day, day - INTERVAL 1 DAY]) AS start FROM d), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT event_type, start, count(*) AS n FROM w, m WHERE start + INTERVAL 2 DAY <= mark GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    found = streams.run_to_end(streams.windows(_stream(spark, sf_dir), "event_type", "2 days", "1 day", "1 day"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH r AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS hit FROM events), h AS (SELECT user_id, max(ts) FILTER (hit) AS last_hit FROM r GROUP BY 1)
SELECT r.user_id, count(*) FILTER (last_hit IS NULL OR ts > last_hit) AS missed, count(*) FILTER (last_hit IS NULL OR ts > last_hit) >= 3 AS cancelled FROM r JOIN h USING (user_id) GROUP BY 1""")
def stream_state(spark, sf_dir):
    """The counter after all events: of the rows that batches give, each key's last one."""
    found = streams.run_to_end(streams.count_misses(_stream(spark, sf_dir), "user_id", "event_type = 'purchase'", 3))
    return found.groupBy("user_id").agg(F.max_by(F.struct("missed", "cancelled"), "seen").alias("s")).select("user_id", "s.*")


@query("""WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(sum(s) AS BIGINT) AS sessions, count(*) AS n FROM x GROUP BY user_id""")
def stream_rebuild(spark, sf_dir):
    """Rollups of touched owners, rebuilt by batch."""
    import uuid

    def rollup(df):
        return gap_islands(df, ["user_id"], "ts", "event_id", 6 * 3600).groupBy("user_id").agg(F.max("island").alias("sessions"), F.count("*").alias("n"))

    path = f"{shared_folder(spark)}/rebuild-{uuid.uuid4().hex}"
    streams.rebuild_touched(_stream(spark, sf_dir), table(spark, sf_dir, "events"), "user_id", rollup, path)
    return spark.read.parquet(path).select("user_id", "sessions", "n")


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_placed_around(spark, sf_dir):
    """A batch's owners are placed again with a day before its first event; over one batch that is all of history."""
    import uuid

    def place(df):
        return df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))

    path = f"{shared_folder(spark)}/around-{uuid.uuid4().hex}"
    found = streams.place_around(_stream(spark, sf_dir), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", place, path)
    return found.groupBy("user_id", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' AND event_id % 11 = 0")
def retracted_events(spark, sf_dir):
    """Upstream has lost every eleventh event; those of one week are found."""
    events = table(spark, sf_dir, "events")
    since, until = (F.expr(f"timestamp_ntz '2024-01-{d}'") for d in ("03", "10"))
    return streams.retracted(events, events.where("event_id % 11 <> 0"), ["event_id"], since, until).select("event_id")


@query("""WITH r AS (SELECT event_type AS job, ts AS started, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 1 MINUTE END AS finished FROM events WHERE ts <= TIMESTAMP '2024-01-15')
SELECT job, NOT bool_or(started > TIMESTAMP '2024-01-15' - INTERVAL 5 MINUTE) AND NOT bool_or(finished IS NULL AND started > TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR) AS may_start, count(*) FILTER (finished IS NULL AND started <= TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR) AS stale FROM r GROUP BY 1""")
def trigger_guard(spark, sf_dir):
    now = F.expr("timestamp_ntz '2024-01-15'")
    runs = table(spark, sf_dir, "events").where(F.col("ts") <= now).select(F.col("event_type").alias("job"), F.col("ts").alias("started"), F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("interval 1 minute")).alias("finished"))
    return streams.may_start(runs, now)


_LEASE = 48 * 3600 * 1000
_KINDS = {"view": "request", "click": "start", "signup": "renew", "purchase": "ready", "error": "failed"}


@query(f"""WITH RECURSIVE m AS (SELECT epoch_us(max(ts)) // 1000 - 86400000 AS mark FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ms, kind, holder) AS rn FROM (SELECT DISTINCT user_id AS doc, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'start' WHEN 'signup' THEN 'renew' WHEN 'purchase' THEN 'ready' ELSE 'failed' END AS kind, CAST(event_id % 2 AS VARCHAR) AS holder FROM events) WHERE ms < (SELECT mark FROM m)),
w AS (SELECT DISTINCT doc, 0::BIGINT AS rn, 0::BIGINT AS ms, '' AS kind, false AS ok, 'none' AS st, 0::BIGINT AS ver, 0::BIGINT AS att, '' AS hd, 0::BIGINT AS ut, false AS lapsed, 0::BIGINT AS lapse_at, '' AS lapse_st, 0::BIGINT AS lapse_ver, 0::BIGINT AS lapse_att FROM e
  UNION ALL
  SELECT doc, rn, ms, kind, ok, CASE WHEN NOT ok THEN st WHEN kind = 'request' THEN 'requested' WHEN kind IN ('start', 'renew') THEN 'writing' WHEN kind = 'ready' THEN 'ready' WHEN att < 2 THEN 'requested' ELSE 'failed' END,
    CASE WHEN ok AND kind = 'request' THEN ver + 1 ELSE ver END, CASE WHEN ok AND kind = 'request' THEN 0 WHEN ok AND kind = 'start' THEN att + 1 ELSE att END,
    CASE WHEN ok AND kind = 'start' THEN holder WHEN ok AND kind IN ('ready', 'failed') THEN '' ELSE hd END, CASE WHEN ok AND kind IN ('start', 'renew') THEN ms + {_LEASE} WHEN ok AND kind IN ('ready', 'failed') THEN 0 ELSE ut END, lapsed, lapse_at, lapse_st, lapse_ver, lapse_att
  FROM (SELECT *, CASE kind WHEN 'request' THEN st NOT IN ('requested', 'writing') WHEN 'start' THEN st = 'requested' ELSE st = 'writing' AND holder = hd END AS ok
    FROM (SELECT e.doc, e.rn, e.ms, e.kind, e.holder, gone AS lapsed, w.ut AS lapse_at, CASE WHEN gone THEN back ELSE w.st END AS lapse_st, w.ver AS lapse_ver, w.att AS lapse_att, CASE WHEN gone THEN back ELSE w.st END AS st, w.ver, w.att, CASE WHEN gone THEN '' ELSE w.hd END AS hd, CASE WHEN gone THEN 0 ELSE w.ut END AS ut
      FROM (SELECT w.*, CASE WHEN w.att < 2 THEN 'requested' ELSE 'failed' END AS back FROM w) w JOIN e ON e.doc = w.doc AND e.rn = w.rn + 1, LATERAL (SELECT w.st = 'writing' AND w.ut < e.ms AS gone)))),
z AS (SELECT * FROM w QUALIFY rn = max(rn) OVER (PARTITION BY doc))
SELECT doc, make_timestamp(ms * 1000) AS at, kind, ok AS accepted, st AS status, ver AS version, att AS attempts FROM w WHERE rn > 0
UNION ALL SELECT doc, make_timestamp(lapse_at * 1000), 'lapse', true, lapse_st, lapse_ver, lapse_att FROM w WHERE lapsed
UNION ALL SELECT doc, make_timestamp(ut * 1000), 'lapse', true, CASE WHEN att < 2 THEN 'requested' ELSE 'failed' END, ver, att FROM z, m WHERE st = 'writing' AND ut + 1 < mark""")
def lease_transitions(spark, sf_dir):
    """Leases on documents (users), as a keyed state machine with timers: what each request did, and which leases lapsed."""
    from itertools import chain

    kinds = F.create_map(*map(F.lit, chain(*_KINDS.items())))
    events = _stream(spark, sf_dir).select(F.col("user_id").alias("doc"), F.col("ts").alias("at"), kinds[F.col("event_type")].alias("kind"), (F.col("event_id") % 2).cast("string").alias("holder"))
    found = leases.run(spark, events, "1 day", _LEASE)
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM x)
SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n FROM y GROUP BY user_id, k""")
def stream_catch_up(spark, sf_dir):
    """Sessions of a stream, kept right by rebuilding from the first one that a batch can change."""
    import uuid

    found = catchup.keep_sessions(_stream(spark, sf_dir), "user_id", "event_id", 6 * 3600, f"{shared_folder(spark)}/catchup-{uuid.uuid4().hex}")
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")), "n")
