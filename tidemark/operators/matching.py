"""Matching plays to lists and groups to homes. Ties decide nothing, so results don't depend on row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def either_equal(left: DataFrame, right: DataFrame, group: str, line: str, keys: list[tuple[str, str]]) -> DataFrame:
    """Per group, how many lines have another line that agrees in any of the keys: one equi-join with the alternatives as its condition."""
    a, b = left.alias("a"), right.alias("b")
    any_key = reduce(lambda x, y: x | y, (F.col(f"a.{p}") == F.col(f"b.{q}") for p, q in keys))
    joined = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{line}") != F.col(f"b.{line}")) & any_key, "left_semi")
    return joined.groupBy(group).agg(F.countDistinct(line).alias("matched"))


def tiered_positions(plays: DataFrame, tracks: DataFrame, group: list[str], play: list[str], tiers: list[tuple[str, str]], position: str) -> DataFrame:
    """The least position of the first tier by which a play is found; plays that are not found are left out."""
    found = []
    for i, (of_play, of_track) in enumerate(tiers):
        listed = tracks.groupBy(*group, F.col(of_track).alias("_key")).agg(F.min(position).alias(position))
        found.append(plays.withColumn("_key", F.col(of_play)).join(listed, [*group, "_key"]).select(*group, *play, F.lit(i).alias("_tier"), position))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*group, *play).agg(F.min(F.struct("_tier", position)).alias("_m")).select(*group, *play, F.col(f"_m.{position}").alias(position))


def fold_untracked(untracked: DataFrame, tracked: DataFrame, key: str, id_col: str) -> DataFrame:
    """Every untracked group with the only tracked group of its key, if there is just one."""
    homes = tracked.groupBy(key).agg(F.count("*").alias("_n"), F.min(id_col).alias("home")).where("_n = 1").select(key, "home")
    return untracked.join(homes, key).select(id_col, "home")


def pick_by_overlap(unmapped: DataFrame, mapped: DataFrame, owner: list[str], title: str, id_col: str) -> DataFrame:
    """For each unmapped group, the mapped one of the same owner that shares most titles; ties give none."""
    a = unmapped.select(*owner, title, F.col(id_col).alias("unmapped"))
    b = mapped.select(*owner, title, F.col(id_col).alias("home"))
    shared = a.join(b, [*owner, title]).groupBy("unmapped", "home").agg(F.countDistinct(title).alias("shared"))
    best = F.max("shared").over(Window.partitionBy("unmapped"))
    top = shared.withColumn("_best", best).where("shared = _best").drop("_best")
    return top.withColumn("_n", F.count("*").over(Window.partitionBy("unmapped"))).where("_n = 1").drop("_n")
