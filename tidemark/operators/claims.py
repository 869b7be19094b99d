"""Batches of claims, slices of entries and the states that actions leave, as joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept

from .relational import first_per


def slice_targets(entries: DataFrame, on_path: DataFrame, in_slice: Column, tiers: dict[str, int]) -> DataFrame:
    """Entries of a slice's lanes and of its path, each once: all columns, on_path, tier.

    entries: entry, priority, start_here and the columns of in_slice; on_path: entry. A priority that has no tier counts as
    the second-last one. Entries to start with, and those on the path, come right after the first tier.
    """
    path = on_path.select("entry").distinct().withColumn("on_path", F.lit(True))
    marked = entries.join(path, "entry", "left").withColumn("on_path", F.coalesce("on_path", F.lit(False))).where(in_slice | F.col("on_path"))
    known = F.create_map(*(F.lit(x) for pair in tiers.items() for x in pair))
    tier = F.coalesce(known[F.col("priority")], F.lit(sorted(tiers.values())[-2]))
    early = (tier > 0) & (F.col("start_here") | F.col("on_path"))
    return first_per(marked.withColumn("tier", F.when(early, 1).otherwise(tier)), ["entry"], F.asc("tier"))


def load_claims(stored: DataFrame, new: DataFrame, albums: DataFrame, batch: str) -> DataFrame:
    """Stored and newly loaded claims: key, label, status.

    stored: key, label, status. new: album, key, place, replaces (a stored label or null). albums: album. Claims on albums
    outside of the batch are left out. A claim's label is the batch, its album and its number there. A key that is stored
    already, or repeated within the batch, is not loaded again; a stored claim is superseded only if one that replaces it
    has been loaded.
    """
    inside = new.join(albums.select("album").distinct(), "album", "left_semi")
    number = F.row_number().over(Window.partitionBy("album").orderBy("place", "key"))
    label = F.format_string(f"{batch}-%s-L%03d", F.col("album").cast("string"), number)
    fresh = first_per(inside.withColumn("label", label), ["key"], F.asc("label")).join(stored.select("key"), "key", "left_anti")
    retired = fresh.where("replaces is not null").select(F.col("replaces").alias("label")).distinct().withColumn("_gone", F.lit(True))
    kept = stored.join(retired, "label", "left").select("key", "label", F.when(F.col("_gone"), "superseded").otherwise(F.col("status")).alias("status"))
    return kept.union(fresh.select("key", "label", F.lit("proposed").alias("status")))


def queue_states(actions: DataFrame, item: str, now: Column, bump_days: int = 14, snooze_days: int = 30) -> DataFrame:
    """What all actions on an item leave: pinned, bumped, snoozed, hidden (boolean), plays (long).

    actions: item, action, at (a time), id (orders equal times). Hiding takes a pin away; a bump and a snooze end after
    their days; plays of one time are one. Each state is a maximum, so a task sends one row per item.
    """

    def last(*names: str) -> Column:
        return F.max(F.when(F.col("action").isin(*names), F.struct("at", "id", "action")))

    found = actions.groupBy(item).agg(
        last("pin", "unpin", "hide").alias("pin"), last("bump").alias("bump"), last("snooze", "unsnooze").alias("snooze"),
        last("hide", "unhide").alias("hide"), F.countDistinct(F.when(F.col("action") == "played", F.col("at"))).alias("plays"),
    )
    age = lambda c: F.datediff(now, F.col(f"{c}.at"))
    state = lambda name, ok: F.coalesce(ok, F.lit(False)).alias(name)
    return found.select(
        item, state("pinned", F.col("pin.action") == "pin"), state("bumped", age("bump") < bump_days),
        state("snoozed", (F.col("snooze.action") == "snooze") & (age("snooze") < snooze_days)), state("hidden", F.col("hide.action") == "hide"), "plays",
    )


def manual_sessions(plays: DataFrame, undone: DataFrame, minutes: int = 60) -> DataFrame:
    """Sessions marked by hand (plays: id, item, at, tracks) that stand: all but those taken back (undone: id, at) within so many
    minutes. A whole session of the item's tracks, at one time."""
    first = undone.groupBy("id").agg(F.min("at").alias("_undone"))
    joined = plays.join(first, "id", "left")
    stands = F.col("_undone").isNull() | (F.unix_micros(F.col("_undone").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) >= minutes * 60_000_000)
    return joined.where(stands).select("id", "item", F.col("at").alias("started_at"), F.coalesce("tracks", F.lit(1)).alias("tracks_played"), F.lit("full").alias("session_type"), F.lit("manual").alias("source"))


def same_names(asked: DataFrame, known: DataFrame, least: int = 5) -> DataFrame:
    """Pairs of keys (a, b) that name one thing: equal, or the shorter one, of `least` characters or more, inside of the longer.

    asked: a; known: b (keys, without repeats). Of the shorter key's runs of `least` characters the one that fewest longer
    keys have leads to these: a head that very many names share leads nowhere as long as there is a rarer run.
    """
    a, b = asked.where("a <> ''"), known.where("b <> ''")
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (least - 1)), lambda i: F.substring(c, i, F.lit(least))))

    def inside(short: DataFrame, s: str, long: DataFrame, g: str) -> DataFrame:
        cut = kept(long.where(F.length(g) >= least).select(g, F.explode(runs(g)).alias("run")), "runs")
        counts = cut.groupBy("run").agg(F.count("*").alias("n"))
        asked_runs = short.where(F.length(s) >= least).select(s, F.explode(runs(s)).alias("run")).join(counts, "run", "left")
        # A run that no longer key has rules the short one out.
        rarest = asked_runs.groupBy(s).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).where("r.n > 0").select(s, F.col("r.run").alias("run"))
        return rarest.join(cut, "run").where(F.contains(F.col(g), F.col(s))).select("a", "b")

    equal = a.join(b, F.col("a") == F.col("b")).select("a", "b")
    return equal.union(inside(a, "a", b, "b")).union(inside(b, "b", a, "a")).distinct()
