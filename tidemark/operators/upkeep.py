"""Upkeep of a catalogue: keys filled and renewed, entries restored, entities linked, work that is due, files converted, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import broadcast_if_small, kept

NAMES_SENT = 1_000_000


def fill_keys(rows: DataFrame, name: str, key: str, make: Column) -> DataFrame:
    """rows with their missing keys filled: each different name is made a key once (make: an expression over the name), and
    only names of rows without one are. Rows that have a key, or no name, stay as they are."""
    missing = rows.where(F.col(key).isNull() & F.col(name).isNotNull()).select(name).distinct()
    made = broadcast_if_small(kept(missing.select(F.col(name), F.coalesce(F.nullif(make, F.lit("")), F.lower(name)).alias("_made")), "keys"), NAMES_SENT)
    return rows.join(made, name, "left").withColumn(key, F.coalesce(F.col(key), "_made")).select(*rows.columns)


def renew_keys(rows: DataFrame, title: str, key: str, make: Column) -> DataFrame:
    """rows with keys made anew from their titles, and `changed`: only rows that are changed need to be written."""
    made = rows.select(title).distinct().withColumn("_made", make)
    joined = rows.join(made, title, "left")
    return joined.withColumn("changed", ~F.col("_made").eqNullSafe(F.col(key))).withColumn(key, F.col("_made")).select(*rows.columns, "changed")


def restore(entries: DataFrame, groups: DataFrame, is_kind: Column) -> DataFrame:
    """entries with review set to accepted again where it was rejected and the group is of a kind (a condition over groups)."""
    of_kind = groups.where(is_kind).select("group_id", F.lit(True).alias("_kind"))
    back = F.coalesce("_kind", F.lit(False)) & (F.col("review") == "rejected")
    return entries.join(of_kind, "group_id", "left").withColumn("restored", back).withColumn("review", F.when(back, "accepted").otherwise(F.col("review"))).select(*entries.columns, "restored")


def link_entities(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """entities (id, mbid, group_id) with the group of their mbid, where they have none and no entity has that group yet. Of
    several entities of one mbid the least id gets it."""
    taken = entities.where("group_id is not null").select("group_id")
    free = groups.where("mbid is not null").join(taken, "group_id", "left_anti").groupBy("mbid").agg(F.min("group_id").alias("free"))
    asking = entities.where("group_id is null and mbid is not null").groupBy("mbid").agg(F.min("id").alias("id")).join(free, "mbid").select("id", "free")
    return entities.join(asking, "id", "left").withColumn("linked", F.col("free").isNotNull()).withColumn("group_id", F.coalesce("group_id", "free")).select(*entities.columns, "linked")


def due(rows: DataFrame, now: Column, retry_days: int, pattern: str) -> DataFrame:
    """rows (source, tried, note) that are due, with why: never tried, tried long enough ago, or noted with a reason that has gone."""
    unresolved = F.col("source") == "unresolved"
    why = F.when(F.col("source").isNull(), "never").when(unresolved & F.col("note").like(pattern), "reason gone").when(unresolved & (F.col("tried") < now - F.make_interval(days=F.lit(retry_days))), "again")
    return rows.withColumn("why", why).where("why is not null")


def add_slice(rows: DataFrame, slices: str, name: str, where: Column) -> DataFrame:
    """rows with a name appended to their array of slices where a condition holds and it is not there yet."""
    held = F.coalesce(F.col(slices), F.array().cast("array<string>"))
    return rows.withColumn(slices, F.when(where & ~F.array_contains(held, name), F.concat(held, F.array(F.lit(name)))).otherwise(F.col(slices)))


def merged_lists(*fields: Column, nothing: str = "NA") -> Column:
    """Comma lists as one, each entry once and in order, without blanks and entries that say nothing."""
    parts = F.flatten(F.array(*(F.transform(F.split(F.coalesce(f, F.lit("")), ","), lambda x: F.trim(x)) for f in fields)))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != nothing))), ", ")


def tier(rank: Column, bounds: dict[int, str], rest: str) -> Column:
    """The name of the first bound that a rank is within."""
    out = None
    for bound, name in sorted(bounds.items()):
        out = F.when(rank <= bound, name) if out is None else out.when(rank <= bound, name)
    return F.lit(rest) if out is None else out.otherwise(rest)


def clean_genres(raw: Column, drop: list[str]) -> Column:
    """Names in a source's genre text: without notes in brackets, parted at commas and semicolons, lower case, single blanks;
    without lost characters, names to drop, and names that hold no letter or digit."""
    text = F.regexp_replace(raw, r"\s*\([^)]*\)|\s*\[[^\]]*\]", "")
    parts = F.transform(F.split(text, "[,;]"), lambda p: F.trim(F.regexp_replace(F.lower(F.regexp_replace(p, " ", " ")), r"\s+", " ")))
    return F.filter(parts, lambda p: (p != "") & ~F.contains(p, F.lit("�")) & p.rlike(r"[\p{L}\p{N}]") & ~p.isin(*drop))


def genre_title(name: Column, acronyms: list[str]) -> Column:
    """A name for a heading: its first letter a capital, acronyms all capitals."""
    words = F.transform(F.split(name, " "), lambda w, i: F.when(w.isin(*acronyms), F.upper(w)).when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w))
    return F.array_join(words, " ")


def report_table(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Lines of a markdown table of a small result, numbered: heading, rule, and one line for each row, by group."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (group, *columns))), " | "), F.lit(" |"))
    head = f"| {' | '.join((group, *columns))} |"
    body = rows.select(F.lit(2).alias("part"), F.col(group).cast("string").alias("at"), line.alias("line"))
    top = rows.sparkSession.createDataFrame([(0, "", head), (1, "", f"|{'---|' * (1 + len(columns))}")], "part int, at string, line string")
    return top.unionByName(body)
