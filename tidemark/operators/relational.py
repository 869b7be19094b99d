"""Relational operators that are more than one DataFrame method: narrowing, first rows, laterals, ranked and tiered joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept


def optional_filter(df: DataFrame, **equal) -> DataFrame:
    """Keeps rows equal to every value given; None means no condition."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), equal.items(), df)


def half_open(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from start on and before end; None leaves a side open."""
    at = lambda x: F.lit(x).cast(df.schema[column].dataType)
    if start is not None:
        df = df.where(F.col(column) >= at(start))
    return df if end is None else df.where(F.col(column) < at(end))


def narrow(df: DataFrame, key: list[str], *keeps: Column) -> DataFrame:
    """Applies each condition in turn to the rows of a key, but only where something survives it.

    One sum over the keys tells which sets of conditions some row meets together (2 ^ n booleans for each key, n conditions,
    partly summed before the shuffle); from these follows which conditions count for a key. Rows are joined with that and
    never gathered by key.
    """
    met = [F.coalesce(k, F.lit(False)) for k in keeps]
    sets = [tuple(i for i in range(len(met)) if n >> i & 1) for n in range(1, 1 << len(met))]
    name = lambda s: "_" + "_".join(map(str, s))
    some = df.groupBy(*key).agg(*(F.bool_or(reduce(lambda a, b: a & b, (met[i] for i in s))).alias(name(s)) for s in sets))

    def counting(chosen: tuple, i: int) -> Column:
        """The conditions that count, from the i-th on, if these do before it: an array of their numbers."""
        if i == len(met):
            return F.array(*map(F.lit, chosen)) if chosen else F.array().cast("array<int>")
        return F.when(F.col(name((*chosen, i))), counting((*chosen, i), i + 1)).otherwise(counting(chosen, i + 1))

    counted = some.select(*key, counting((), 0).alias("_counts"))
    joined = df.withColumns({f"_met{i}": m for i, m in enumerate(met)}).join(counted, key)
    good = reduce(lambda a, b: a & b, (F.col(f"_met{i}") | ~F.array_contains("_counts", i) for i in range(len(met))))
    return joined.where(good).select(*df.columns)


def first_per(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of every key."""
    return top_per(df, key, 1, *order).drop("rank")


def top_per(df: DataFrame, key: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def numbered_top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of all, numbered. The limit comes first, so the one task that numbers them sees k rows only."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def pick_if_unique(df: DataFrame, key: list[str], *choices: str) -> DataFrame:
    """The only value of the first column that has exactly one within the key; null if none has."""
    value = reduce(lambda rest, c: F.when(F.countDistinct(c) == 1, F.min(c)).otherwise(rest), reversed(choices), F.lit(None))
    return df.groupBy(*key).agg(value.alias("picked"))


def tiered(query_key: list[str], *tiers: DataFrame) -> DataFrame:
    """Matches of the best tier that has any, with its number."""
    numbered = reduce(DataFrame.unionByName, (t.withColumn("tier", F.lit(i + 1)) for i, t in enumerate(tiers)))
    w = Window.partitionBy(*query_key)
    return numbered.withColumn("_best", F.min("tier").over(w)).where("tier = _best").drop("_best")


def either_key_join(left: DataFrame, right: DataFrame, keys: list[Column], right_key: str) -> DataFrame:
    """Joins on any of several keys of a row, each match once."""
    exploded = left.withColumn("_key", F.explode(F.array_distinct(F.array(*keys)))).where("_key is not null")
    return exploded.join(right, F.col("_key") == right[right_key]).drop("_key")


def either_key_count(left: DataFrame, right: DataFrame, left_id: str, keys: list[Column], right_key: str, right_id: str, name: str) -> DataFrame:
    """left_id and how many different right_id it meets by any of several keys, for those that meet some.

    Rows of left with the same keys meet the same rows, so each different set of keys is joined once, and its count brought
    to the rows.
    """
    each = left.select(left_id, F.explode(F.array(*keys)).alias("_k")).where("_k is not null")
    by_keys = each.groupBy(left_id).agg(F.array_sort(F.collect_set("_k")).alias("_keys"))
    sets = by_keys.select("_keys").distinct().select("_keys", F.explode("_keys").alias("_k"))
    met = sets.join(right.select(F.col(right_key).alias("_k"), right_id), "_k").groupBy("_keys").agg(F.countDistinct(right_id).alias("_n"))
    return by_keys.join(met, "_keys").select(left_id, F.col("_n").alias(name))


def nearest_within(a: DataFrame, b: DataFrame, metres: float, a_id: str, b_id: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The nearest b of every a within a distance (equirectangular), through grid cells of the distance looked in.

    Where b stand close, that distance starts small, so that no cell of b holds more than _FULL_CELL different places (_HALVINGS
    halvings at most), and doubles for those a that have found none: a nearest one within a distance is the nearest of all. Of
    several b in one place the least id stands for them.
    """
    places = kept(b.groupBy(F.col(lat), F.col(lon)).agg(F.min(b_id).alias(b_id)), "places")
    radius, found, left = metres, None, kept(a.select(a_id, lat, lon), "nearest-of")
    halved = 0
    while halved < _HALVINGS and _fullest(places, radius, lat, lon) > _FULL_CELL:
        radius, halved = radius / 2, halved + 1
    for n in range(halved, -1, -1):
        near = _within(left, places, metres / 2**n, a_id, b_id, lat, lon)
        if n:
            near = kept(near, "nearest")
            left = kept(left.join(near.select(a_id), a_id, "left_anti"), "nearest-of")
        found = near if found is None else found.unionByName(near)
    return found


#: Different places in the fullest cell that is looked in, and how often the distance is halved for that.
_FULL_CELL, _HALVINGS = 64, 12


def _fullest(places: DataFrame, metres: float, lat: str, lon: str) -> int:
    """How many places stand in the fullest square of this side, about."""
    cell = metres / 111_320.0
    return places.groupBy(F.floor(F.col(lat) / cell), F.floor(F.col(lon) / cell)).count().agg(F.max("count")).first()[0] or 0


def _within(a: DataFrame, b: DataFrame, metres: float, a_id: str, b_id: str, lat: str, lon: str) -> DataFrame:
    """The nearest b of every a that has one within a distance.

    A cell is as high as the distance and twice as wide at the equator. Nearer the poles a row looks as many cells to
    either side as the distance spans at its latitude (a cell further towards the pole). Cells go round: those on both sides
    of the 180th meridian are neighbours.
    """
    cell = metres / 111_320.0
    columns = max(1, int(360 / (2 * cell)))
    gx, gy = F.floor((F.col(lon) + 180) * columns / 360), F.floor(F.col(lat) / cell)
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    narrow = F.cos(F.radians(F.least(F.abs(F.col(lat)) + cell, F.lit(89.9))))
    side = F.least(F.ceil(1 / (2 * narrow)).cast("long"), F.lit(columns))
    left = a.select(F.col(a_id), F.col(lat).alias("a_lat"), F.col(lon).alias("a_lon"), F.explode(F.array_distinct(F.transform(F.sequence(-side, side), lambda d: F.pmod(gx + d, F.lit(columns))))).alias("cx"), gy.alias("gy")).select("*", F.explode(F.transform(around, lambda d: F.col("gy") + d)).alias("cy"))
    right = b.select(F.col(b_id), F.col(lat).alias("b_lat"), F.col(lon).alias("b_lon"), F.pmod(gx, F.lit(columns)).alias("cx"), gy.alias("cy"))
    apart = F.col("b_lon") - F.col("a_lon")
    apart = F.when(apart > 180, apart - 360).when(apart < -180, apart + 360).otherwise(apart)
    dx = F.radians(apart) * F.cos(F.radians((F.col("a_lat") + F.col("b_lat")) / 2))
    dy = F.radians(F.col("b_lat") - F.col("a_lat"))
    paired = left.join(right, ["cx", "cy"]).withColumn("metres", F.lit(6_371_000.0) * F.sqrt(dx * dx + dy * dy)).where(F.col("metres") <= metres)
    return paired.groupBy(a_id).agg(F.min(F.struct("metres", b_id)).alias("n")).select(a_id, F.col(f"n.{b_id}").alias(b_id), F.col("n.metres").alias("metres"))


def reconcile(upstream: DataFrame, stored: DataFrame, second: str, title: str, id_col: str) -> DataFrame:
    """Per second: surplus, missing, and whether surplus rows may be deleted. A second is ambiguous if the rows whose
    title upstream lacks are not exactly as many as the surplus."""
    up = upstream.groupBy(second, title).agg(F.count("*").alias("u"))
    st = stored.groupBy(second, title).agg(F.count("*").alias("s"), F.min(id_col).alias("least_id"))
    both = up.join(st, [second, title], "full_outer").select(second, title, F.coalesce("u", F.lit(0)).alias("u"), F.coalesce("s", F.lit(0)).alias("s"))
    seconds = both.groupBy(second).agg(
        F.sum("u").alias("upstream"), F.sum("s").alias("stored"), F.sum(F.when(F.col("u") == 0, F.col("s")).otherwise(0)).alias("unmatched")
    )
    surplus = F.greatest(F.col("stored") - F.col("upstream"), F.lit(0))
    return seconds.select(
        second, surplus.alias("surplus"), F.greatest(F.col("upstream") - F.col("stored"), F.lit(0)).alias("missing"),
        ((surplus > 0) & (surplus != F.col("unmatched"))).alias("ambiguous"),
    )
