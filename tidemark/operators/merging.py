"""Merging rows that stand for one thing: which ones, where chains of merges end, what moves, and taking it back.

A merge never loses anything: the log has one row for every value that it changed, so that any of the merges can be undone
by itself, in any order, as long as what it moved has not been merged on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept



def closure(pairs: DataFrame) -> DataFrame:
    """old_id, new_id: each id that goes (pairs: gone, keep) with the last one of its chain, however long.

    Of several rows of one id that goes, the least keep counts; self pairs and nulls are ignored. Each round joins every
    pointer to the pointer of its target, so it looks twice as far; ids that have arrived are left out of the join, so a
    target of very many is no hot key once it is final. A cycle has no end: it is refused.
    """
    known = pairs.where("gone is not null and keep is not null and gone <> keep")
    hops = kept(known.groupBy(F.col("gone").alias("old_id")).agg(F.min("keep").alias("new_id")), "closure")
    done, longest = None, hops.count()
    for _ in range(longest.bit_length() + 1):
        every = hops if done is None else hops.unionByName(done)
        onward = every.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("further"))
        looked = kept(hops.join(onward, "new_id", "left"), "closure")
        there = looked.where("further is null").select("old_id", "new_id")
        done = there if done is None else done.unionByName(there)
        hops = looked.where("further is not null").select("old_id", F.col("further").alias("new_id"))
        if not hops.limit(1).count():
            return done
    raise ValueError("the pairs have a cycle")


def _alike(alike: Column | None) -> Column:
    kinds = F.col("l.kind") == F.col("f.kind")
    return (F.col("l.key") == F.col("f.key")) & (kinds if alike is None else kinds | alike)


def _met(things: DataFrame, shared: DataFrame, alike: Column | None) -> DataFrame:
    """id, first, last for every loose thing that has a context in common with a firm namesake: the least and the greatest of these.

    Firm things of one key, kind and context are one row, so pairs of loose and firm things are never made.
    """
    contexts = shared.select("id", "context").where("context is not null")
    firm = things.where("firm").join(contexts, "id").groupBy("key", "kind", "context").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    loose = things.where("not firm").join(contexts, "id").select("id", "key", "kind", "context").distinct()
    met = loose.alias("l").join(firm.alias("f"), (F.col("l.context") == F.col("f.context")) & _alike(alike))
    return met.groupBy(F.col("l.id").alias("id")).agg(F.min("f.first").alias("first"), F.max("f.last").alias("last"))


def chosen_merges(things: DataFrame, shared: DataFrame, alike: Column | None = None) -> DataFrame:
    """gone, keep: the pairs that choose_merges gives as merge, without any of the others being made."""
    return _met(things, shared, alike).where("first = last").select(F.col("id").alias("gone"), F.col("first").alias("keep"))


def choose_merges(things: DataFrame, shared: DataFrame, alike: Column | None = None) -> DataFrame:
    """loose, firm, outcome for every loose thing that has a firm namesake.

    things: id, key, kind, firm (boolean). shared: id, context (where a thing occurs). A pair has one key and kinds that are
    equal, or alike (a condition over l.kind and f.kind). It merges if it alone, of the loose one's pairs, has a context in
    common; outcome is merge, several (more have), none, or apart (another one of its pairs merges). What a loose thing meets is
    known before its pairs are made: these are the last step, and are neither kept nor shuffled.
    """
    loose = kept(things.where("not firm").join(_met(things, shared, alike), "id", "left").select("id", "key", "kind", "first", "last"), "merge-loose")
    outcome = F.when(F.col("l.first").isNull(), "none").when(F.col("l.first") != F.col("l.last"), "several").when(F.col("l.first") == F.col("f.id"), "merge").otherwise("apart")
    pairs = loose.alias("l").join(things.where("firm").alias("f"), _alike(alike))
    return pairs.select(F.col("l.id").alias("loose"), F.col("f.id").alias("firm"), outcome.alias("outcome"))


@dataclass
class Merged:
    things: DataFrame
    claims: DataFrame
    links: DataFrame
    log: DataFrame


def _moved(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with new_<column>: where the id in column goes, else null."""
    m = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias(f"new_{column}"))
    return rows.join(m, column, "left")


def _entry(rows: DataFrame, old: str | Column, new: str | Column, what: str, ref: str | Column, was: str | Column) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(as_col(old).cast("long").alias("old_id"), as_col(new).cast("long").alias("new_id"), F.lit(what).alias("what"), as_col(ref).cast("string").alias("ref"), as_col(was).cast("string").alias("was"))


def apply_merges(things: DataFrame, claims: DataFrame, links: DataFrame, mapping: DataFrame, *, ends: tuple[str, ...] = ("subject", "object"), context: str = "context", same: tuple[str, ...] = ("predicate", "source")) -> Merged:
    """Every old_id of mapping (as closure gives it) folded into its new_id.

    things: id and more; claims: claim, the id columns in `ends` and `context`, status, and the columns in `same` that make
    a claim with its ends; links: id, url. Claims point at what is kept. A claim that has moved and now says what another
    one says is superseded: the first that was there stays, else the first that moved. Links of what goes are added where
    the kept one lacks them. The log names every change with the value before it.
    """
    columns = claims.columns
    moved = reduce(lambda rows, c: _moved(rows, mapping, c), (*ends, context), claims)
    touched = reduce(lambda a, b: a | b, (F.col(f"new_{c}").isNotNull() for c in ends))
    for c in (*ends, context):
        moved = moved.withColumn(f"was_{c}", F.col(c)).withColumn(c, F.coalesce(f"new_{c}", c))
    moved = kept(moved.withColumn("touched", touched).withColumn("says", F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in (*ends, *same))), 256)), "merged-claims")
    # Claims that nothing has moved are looked at only where a moved one says the same.
    said = moved.where("touched").select("says").distinct()
    first = moved.join(said, "says", "left_semi").groupBy("says").agg(F.min(F.when(~F.col("touched"), F.col("claim"))).alias("there"), F.min("claim").alias("first"))
    settled = moved.join(first, "says", "left").withColumn("was_status", F.col("status"))
    late = F.col("touched") & (F.col("claim") != F.coalesce("there", "first"))
    settled = kept(settled.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("status", F.when(F.col("late"), "superseded").otherwise(F.col("status"))), "merged-claims")
    log = [_entry(settled.where(f"new_{c} is not null"), f"was_{c}", c, c, "claim", f"was_{c}") for c in (*ends, context)]
    # A status goes with the first end that moved.
    log.append(_entry(settled.where("late"), F.coalesce(*(F.when(F.col(f"new_{c}").isNotNull(), F.col(f"was_{c}")) for c in ends)), F.coalesce(*(f"new_{c}" for c in ends)), "status", "claim", "was_status"))

    going = _moved(links, mapping, "id")
    carried = kept(going.where("new_id is not null"), "merged-links")
    stays = going.where("new_id is null").select(*links.columns)
    arriving = carried.drop("id").withColumnRenamed("new_id", "id").select(*links.columns).dropDuplicates(["id", "url"]).join(stays.select("id", "url"), ["id", "url"], "left_anti").select(*links.columns)
    row_of = lambda rows, names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    log.append(_entry(carried, "id", "new_id", "link", "url", row_of(carried, links.columns)))
    log.append(_entry(arriving, "id", "id", "arrived", "url", F.lit(None)))

    gone = _moved(things, mapping, "id").where("new_id is not null")
    log.append(_entry(gone, "id", "new_id", "thing", "id", row_of(gone, things.columns)))
    rest = things.join(mapping.select(F.col("old_id").alias("id")), "id", "left_anti").select(*things.columns)
    return Merged(rest, settled.select(*columns), stays.unionByName(arriving), kept(reduce(DataFrame.unionByName, log), "merge-log"))


def undo_merges(merged: Merged, chosen: DataFrame | None = None, *, ends: tuple[str, ...] = ("subject", "object"), context: str = "context") -> Merged:
    """Takes back the merges of chosen (old_id), or all: every value of the log is put back where it was.

    A link that a merge brought to the kept thing goes again, unless a merge that is not taken back brings it too.
    """
    log = merged.log if chosen is None else merged.log.join(chosen.select("old_id"), "old_id", "left_semi")
    things, links = (df.sparkSession.createDataFrame([], df.schema) for df in (merged.things, merged.links))
    back = lambda what, like: log.where(F.col("what") == what).select(F.from_json("was", like.schema).alias("r")).select("r.*")
    put = log.where(F.col("what").isin(*ends, context, "status")).groupBy(F.col("ref").alias("claim_ref")).agg(*(F.max(F.when(F.col("what") == c, F.col("was"))).alias(f"put_{c}") for c in (*ends, context, "status")))
    claims = merged.claims.join(put, F.col("claim").cast("string") == F.col("claim_ref"), "left")
    for c in (*ends, context, "status"):
        claims = claims.withColumn(c, F.coalesce(F.col(f"put_{c}").cast(merged.claims.schema[c].dataType), F.col(c)))
    restored = back("link", links)
    gone = log.where("what = 'link'").select(F.col("new_id").alias("id"), F.col("ref").alias("url")).distinct()
    if chosen is not None:
        others = merged.log.where("what = 'link'").join(chosen.select("old_id"), "old_id", "left_anti")
        gone = gone.join(others.select(F.col("new_id").alias("id"), F.col("ref").alias("url")), ["id", "url"], "left_anti")
    brought = gone.join(merged.log.where("what = 'arrived'").select(F.col("new_id").alias("id"), F.col("ref").alias("url")), ["id", "url"], "left_semi")
    kept_links = merged.links.join(brought, ["id", "url"], "left_anti").select(*merged.links.columns)
    left = merged.log if chosen is not None else merged.log.limit(0)
    left = left.join(chosen.select("old_id"), "old_id", "left_anti") if chosen is not None else left
    return Merged(merged.things.unionByName(back("thing", things)), claims.select(*merged.claims.columns), kept_links.unionByName(restored), left)


def move_rows(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with every id in column that goes replaced by the one that is kept."""
    return _moved(rows, mapping, column).withColumn(column, F.coalesce(f"new_{column}", column)).select(*rows.columns)
