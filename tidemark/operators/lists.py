"""Curated lists: entry status, progress, release choice, ranked tags, snapshot counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_per, narrow


def entry_status(entries: DataFrame, key: str, plays: DataFrame, play_key: str, full: Column, part: Column) -> DataFrame:
    """entries with fulls, parts and status: heard, started or unheard."""
    counted = plays.groupBy(F.col(play_key).alias(key)).agg(F.count(F.when(full, 1)).alias("fulls"), F.count(F.when(part, 1)).alias("parts"))
    joined = entries.join(counted, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fulls", "parts")})
    return joined.withColumn("status", F.when(F.col("fulls") > 0, "heard").when(F.col("parts") > 0, "started").otherwise("unheard"))


def progress(entries: DataFrame, key: list[str]) -> DataFrame:
    """Counts of each status and the share heard in per cent, one place, half up."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    share = F.floor((2000 * count("heard") + F.count("*")) / (2 * F.count("*"))) / 10
    return entries.groupBy(*key).agg(F.count("*").alias("entries"), *(count(s).alias(s) for s in ("heard", "started", "unheard")), share.alias("pct"))


def choose_release(releases: DataFrame, key: str, id_col: str, tracks: str, official: Column, date: str, months: int = 12) -> DataFrame:
    """One release per key: each rule narrows only if something survives it; the usual track count is the most frequent, then the larger one."""
    kept = narrow(releases, [key], F.col(tracks) > 0, official)
    month = F.year(date) * 12 + F.month(date)
    kept = kept.withColumn("_month", month).withColumn("_first", F.min("_month").over(Window.partitionBy(key))).where(F.col("_month") - F.col("_first") <= months)
    usual = kept.groupBy(key, tracks).agg(F.count("*").alias("_c")).groupBy(key).agg(F.max(F.struct("_c", tracks)).alias("_u")).select(key, F.col(f"_u.{tracks}").alias("_usual"))
    kept = kept.join(usual, key).where(10 * F.col(tracks) >= 6 * F.col("_usual"))
    return first_per(kept, [key], F.asc(tracks), F.asc(date), F.asc(id_col)).select(key, id_col, F.col(tracks).alias("tracks"))


def ranked_tags(tags: DataFrame, item: str, tag: str) -> DataFrame:
    """Tags of each item by citations, then by how many items have them, then by name."""
    cited = tags.groupBy(item, tag).agg(F.count("*").alias("_cited"))
    spread = cited.groupBy(tag).agg(F.count("*").alias("_items"))
    w = Window.partitionBy(item).orderBy(F.desc("_cited"), F.desc("_items"), F.asc(tag))
    return cited.join(spread, tag).select(item, tag, F.row_number().over(w).alias("rank"))


def count_missed(old: DataFrame, seen: DataFrame, key: str, counter: str, limit: int) -> DataFrame:
    """A row that was seen starts again at 0; others count up, and are cancelled at the limit."""
    joined = old.join(seen.withColumn("_seen", F.lit(True)), key, "full_outer")
    missed = F.when(F.col("_seen"), F.lit(0)).otherwise(F.col(counter) + 1)
    return joined.select(key, missed.cast("int").alias(counter), (F.col("_seen").isNull() & (missed >= limit)).alias("cancelled"))
