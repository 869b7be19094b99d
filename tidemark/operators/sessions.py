"""Gap sessions, runs and neighbours in event histories. All windows are partitioned by owner, so they distribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    micros = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def _order(ts: str, tie: str) -> list[Column]:
    return [F.col(ts).asc(), F.col(tie).asc()]


def gap_islands(events: DataFrame, owner: list[str], ts: str, tie: str, gap_seconds: float, change: str | None = None) -> DataFrame:
    """Adds island: counts up when the gap to the event before is longer than gap_seconds (a gap of exactly that much does
    not split) or, with change, when this column differs."""
    w = Window.partitionBy(*owner).orderBy(*_order(ts, tie))
    starts = F.lag(ts).over(w).isNull() | (seconds_between(ts, F.lag(ts).over(w)) > gap_seconds)
    if change:
        starts = starts | ~F.lag(change).over(w).eqNullSafe(F.col(change))
    flagged = events.withColumn("_starts", starts.cast("int"))
    return flagged.withColumn("island", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def share_to_milli(part: Column, whole: Column) -> Column:
    """part / whole rounded to three places, half up, in whole numbers so that ties come out alike everywhere."""
    return F.floor((2000 * part + whole) / (2 * whole)) / 1000


def sessions(events: DataFrame, owner: list[str], ts: str, tie: str, title: str, gap_seconds: float, track_count: int, full_at: float = 0.8, partial_at: float = 0.25, partial_tracks: int = 3) -> DataFrame:
    """Gap sessions with completion: different titles of track_count; full, partial or none."""
    islands = gap_islands(events, owner, ts, tie, gap_seconds)
    grouped = islands.groupBy(*owner, "island").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("listen_count"), F.countDistinct(title).alias("tracks_played")
    )
    share = F.col("tracks_played") / F.lit(track_count)
    kind = F.when(share >= full_at, "full").when((share >= partial_at) & (F.col("tracks_played") >= partial_tracks), "partial").otherwise("none")
    return grouped.withColumn("completion", share_to_milli(F.col("tracks_played"), F.lit(track_count))).withColumn("session_type", kind)


def sessions_rollup(found: DataFrame, owner: list[str]) -> DataFrame:
    count = lambda kind: F.count(F.when(F.col("session_type") == kind, 1))
    return found.groupBy(*owner).agg(
        F.count("*").alias("sessions"), count("full").alias("full_sessions"), count("partial").alias("partial_sessions"),
        F.max("completion").alias("best_completion"), F.sum("listen_count").alias("listens"), F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"),
    )


def runs(events: DataFrame, owner: list[str], ts: str, tie: str, key: str, title: Column, gap_seconds: float, least_titles: int) -> DataFrame:
    """Runs of one key without a longer gap; only those with enough different titles."""
    islands = gap_islands(events.withColumn("_title", title), owner, ts, tie, gap_seconds, change=key)
    return islands.groupBy(*owner, "island", key).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n"), F.countDistinct("_title").alias("titles")
    ).where(F.col("titles") >= least_titles)


def strays(events: DataFrame, owner: list[str], ts: str, tie: str, group: str, gap_seconds: float) -> DataFrame:
    """Events whose neighbours on both sides, each nearer than the gap, agree on another group."""
    w = Window.partitionBy(*owner).orderBy(*_order(ts, tie))
    near = (seconds_between(ts, F.lag(ts).over(w)) < gap_seconds) & (seconds_between(F.lead(ts).over(w), ts) < gap_seconds)
    before, after = F.lag(group).over(w), F.lead(group).over(w)
    return events.withColumn("home", F.when(near & (before == after) & (before != F.col(group)), before)).where("home is not null")


def learn_redirects(stray: DataFrame, item: str, group: str) -> DataFrame:
    """For each item and group the home with most evidence; ties go to the least home."""
    counted = stray.groupBy(item, group, "home").agg(F.count("*").alias("evidence"))
    w = Window.partitionBy(item, group).orderBy(F.desc("evidence"), F.asc("home"))
    return counted.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def flips(events: DataFrame, owner: list[str], ts: str, tie: str, group: str, gap_seconds: float) -> DataFrame:
    """Per owner: how often the group changes between events nearer than the gap."""
    w = Window.partitionBy(*owner).orderBy(*_order(ts, tie))
    flip = (seconds_between(ts, F.lag(ts).over(w)) < gap_seconds) & (F.lag(group).over(w) != F.col(group))
    return events.withColumn("_flip", flip).groupBy(*owner).agg(F.count("*").alias("n"), F.count(F.when(F.col("_flip"), 1)).alias("flips"))


def overlapping(found: DataFrame, key: list[str], id_col: str, start: str, end: str) -> DataFrame:
    """Pairs of intervals of one key that overlap, each once."""
    a, b = found.alias("a"), found.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    return a.join(b, [*on, F.col(f"a.{id_col}") < F.col(f"b.{id_col}"), F.col(f"a.{start}") <= F.col(f"b.{end}"), F.col(f"b.{start}") <= F.col(f"a.{end}")]).select(
        *(F.col(f"a.{k}").alias(k) for k in key), F.col(f"a.{id_col}").alias("first_id"), F.col(f"b.{id_col}").alias("second_id")
    )
