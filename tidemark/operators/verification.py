"""Verification of claims: structure, evidence, dates, covers, databases and independent support, then confidence and status.

A claim is one row: claim, predicate, source, extractor, kind (how it was found), basis, direction, evidence, source_url, album,
subject and object (type, name, key, artist, year), via, corroborated (array). Every family of tests adds the names of what
fails to one array, by columns or by an equi-join to a lookup, so that claims are never compared in pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import held_pieces, page_text
from ..sources.tables import broadcast_if_small, kept
from .claims import same_names

# Sources that are databases, predicates of lineage, the confidence that each kind and basis starts with, the step for each
# independent origin, the most that a claim found by others can reach, and verdicts that reject.
DATABASES = ("musicbrainz", "discogs", "wikidata")
LINEAGE = ("influenced_by", "sounds_like", "covers", "samples", "interpolates")
BASE = {
    ("musicbrainz", "documented"): 0.9, ("discogs", "documented"): 0.9, ("wikidata", "documented"): 0.9, ("extracted", "documented"): 0.75, ("map", "reported"): 0.7, ("map", "inferred"): 0.5,
    ("text", "documented"): 0.8, ("text", "reported"): 0.7, ("text", "inferred"): 0.5,
}
OTHER_BASE, STEP, CAP, EVIDENCE_MOST = 0.5, 0.1, 0.95, 300
REJECTING = ("DOES_NOT_SUPPORT", "NOT_A_CLAIM", "WRONG_DIRECTION")


@dataclass
class Lookups:
    """predicates: predicate, subject_types, object_types. pages: url, body. notes: note, text, cites (array of addresses).
    recordings: work, artist, first (date as text). members: band, person. credits: album, source, person. years: type, key,
    year. album_years: album, year. reader: claim, verdict. Keys are as in the claims."""

    predicates: DataFrame
    pages: DataFrame
    notes: DataFrame
    recordings: DataFrame
    members: DataFrame
    credits: DataFrame
    years: DataFrame
    album_years: DataFrame
    reader: DataFrame


def _names(**tests: Column) -> Column:
    """Names (spaces for underlines) of the tests that are true."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name.replace("_", " "))) for name, bad in tests.items())))


def structure(claims: DataFrame, predicates: DataFrame) -> DataFrame:
    """Adds fails: unknown predicates, types that a predicate does not take, and what its basis or direction must be."""
    known = predicates.select("predicate", F.col("subject_types").alias("_s"), F.col("object_types").alias("_o"))
    joined = claims.join(broadcast_if_small(kept(known, "predicates"), 10_000), "predicate", "left")
    p = F.col("predicate")
    fails = _names(
        unknown_predicate=F.col("_s").isNull(), subject_type=~F.array_contains("_s", F.col("subject.type")), object_type=~F.array_contains("_o", F.col("object.type")),
        must_be_inferred=(p == "sounds_like") & (F.col("basis") != "inferred"), needs_evidence=(p == "influenced_by") & ~F.col("basis").isin("documented", "reported"),
        no_direction=p.isin(*LINEAGE) & (F.col("extractor") == "reader") & ~F.col("direction").eqNullSafe("subject_newer"),
    )
    return joined.withColumn("fails", fails).drop("_s", "_o")


def evidence(claims: DataFrame, pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds to fails what the sources do not bear out: names and field values that are not on their page, and quotes that are not
    there word for word (parts between ellipses each for itself).

    Pages are normalised once. A claim's page comes by its address; of an address with a fragment, the page without it counts too.
    What claims ask of a page is looked up in it together, so a page of very many claims is not read again for each of them.
    """
    body, noted = page_text(F.col("body")), page_text(F.col("text"))
    named = lambda df, kind, key, text: df.select(F.concat(F.lit(kind), key).alias("at"), text.alias("body"))
    texts = named(pages, "page ", "url", body).unionByName(named(pages, "plain ", "url", F.translate(body, "\"'", ""))).unionByName(named(notes, "note ", "note", noted))
    url = F.split(F.coalesce("source_url", F.lit("")), "#")
    page, plain, note = (F.concat(F.lit(kind), key) for kind, key in (("page ", url[0]), ("plain ", url[0]), ("note ", F.split(F.element_at(url, -1), r"\.")[0])))
    hay = F.when(F.col("kind") == "map", note).otherwise(page)
    field = F.startswith("evidence", F.lit("field:"))
    value = page_text(F.element_at(F.split("evidence", "="), -1))
    segments = F.filter(F.transform(F.split(page_text(F.col("evidence")), "…"), lambda x: F.trim(x)), lambda x: x != "")
    quoted = F.col("kind").isin("text", "map") & ~field
    name = F.translate(page_text(F.when(F.col("predicate") == "recorded_at", F.col("object.name")).otherwise(F.col("subject.name"))), "\"'", "")
    bare = F.regexp_replace(name, r"\s+(recording\s+)?studios?(\s+\w+)?$", "")
    none = F.array().cast("array<struct<at:string,piece:string>>")
    piece = lambda at, x: F.struct(at.alias("at"), x.alias("piece"))
    names = F.when(F.col("kind") == "extracted", F.array(piece(plain, name), piece(plain, bare)))
    asked = F.concat(F.coalesce(F.when(quoted, F.transform(segments, lambda x: piece(hay, x))), none), F.coalesce(F.when(field, F.array(piece(page, value))), none), F.coalesce(names, none))
    each = claims.select("claim", F.explode(F.array_distinct(asked)).alias("a")).select("claim", "a.*").where("piece <> ''")
    held = each.join(held_pieces(each, texts), ["at", "piece"]).groupBy("claim").agg(F.collect_set(F.struct("at", "piece")).alias("_held"))
    joined = claims.join(held, "claim", "left").withColumn("_held", F.coalesce("_held", none))
    holds = lambda at, x: F.when(x.isNotNull(), F.array_contains("_held", piece(at, x)))
    on_page = ((name != "") & holds(plain, name)) | ((F.col("predicate") == "recorded_at") & (bare != name) & (F.length(bare) >= 5) & holds(plain, bare))
    fails = _names(
        name_not_on_page=(F.col("kind") == "extracted") & ~on_page, field_not_on_page=field & (F.col("kind") != "owner") & ~((value != "") & holds(page, value)),
        quote_not_in_source=quoted & ~((F.size(segments) > 0) & F.forall(segments, lambda x: holds(hay, x))), evidence_too_long=quoted & (F.length("evidence") > EVIDENCE_MOST),
    )
    return joined.withColumn("fails", F.concat("fails", fails)).drop("_held")


def dates(claims: DataFrame, years: DataFrame, album_years: DataFrame) -> DataFrame:
    """Adds to fails a lineage whose object is newer than its subject; years as stated, else looked up by type and key, else the album's."""
    out = claims
    for side in ("subject", "object"):
        of = years.groupBy(F.col("type").alias("_type"), F.col("key").alias("_key")).agg(F.min("year").alias(f"_{side}_year"))
        out = out.withColumn("_type", F.col(f"{side}.type")).withColumn("_key", F.col(f"{side}.key")).join(of, ["_type", "_key"], "left").drop("_type", "_key")
    out = out.join(album_years.select("album", F.col("year").alias("_album_year")), "album", "left")
    year = lambda side: F.coalesce(F.col(f"{side}.year"), F.col(f"_{side}_year"), F.when(F.col(f"{side}.of_album"), F.col("_album_year")))
    newer = F.col("predicate").isin(*LINEAGE) & (year("object") > year("subject"))
    return out.withColumn("fails", F.concat("fails", _names(object_is_newer=newer))).drop("_subject_year", "_object_year", "_album_year")


def databases(claims: DataFrame, recordings: DataFrame, members: DataFrame, credits: DataFrame) -> DataFrame:
    """Adds db (sources that agree) and to fails: covers of what is not the first recording, or that came out before it.

    covers: the object's work is looked up; member_of and credited_on: the pair is.
    """
    known = recordings.groupBy("work", "artist").agg(F.min("first").alias("first"))
    earliest = known.where("first is not null").groupBy("work").agg(F.min(F.struct("first", "artist")).alias("_e"))
    # Only covers look works up: their key is null elsewhere, and null keys join nothing and are not shuffled onto one another.
    work = F.when(F.col("predicate") == "covers", F.col("object.key"))
    side = lambda s: known.select(F.col("work").alias("_work"), F.col("artist").alias(f"_{s}_artist"), F.col("first").alias(f"_{s}_first"), F.lit(True).alias(f"_{s}_known"))
    out = claims.withColumn("_work", work).withColumn("_subject_artist", F.col("subject.artist")).withColumn("_object_artist", F.col("object.artist"))
    out = out.join(earliest.withColumnRenamed("work", "_work"), "_work", "left").join(side("subject"), ["_work", "_subject_artist"], "left").join(side("object"), ["_work", "_object_artist"], "left")
    not_first = F.col("_object_known") & (F.col("_e.artist") != F.col("_object_artist")) & (F.substring("_e.first", 1, 4) < F.coalesce(F.substring("_object_first", 1, 4), F.lit("9999")))
    before = F.col("_object_first") > F.col("_subject_first")
    agrees = F.col("_object_first") <= F.col("_subject_first")
    out = out.withColumn("fails", F.concat("fails", _names(not_the_first_recording=not_first, database_contradicts=before)))
    out = out.withColumn("db", F.when(agrees, F.array(F.lit("musicbrainz"))).otherwise(F.array().cast("array<string>"))).drop("_work", "_subject_artist", "_object_artist", "_e", *(f"_{s}_{c}" for s in ("subject", "object") for c in ("first", "known")))
    member = members.select(F.col("band").alias("_band"), F.col("person").alias("_person"), F.array(F.lit("musicbrainz")).alias("_m")).distinct()
    of = lambda p, c: F.when(F.col("predicate") == p, F.col(c))
    out = out.withColumn("_band", of("member_of", "object.key")).withColumn("_person", of("member_of", "subject.key")).join(member, ["_band", "_person"], "left")
    credited = credits.groupBy(F.col("album").alias("_on"), F.col("person").alias("_who")).agg(F.array_sort(F.collect_set("source")).alias("_c"))
    out = out.withColumn("_on", of("credited_on", "object.key")).withColumn("_who", of("credited_on", "subject.key")).join(credited, ["_on", "_who"], "left")
    none = F.array().cast("array<string>")
    backed = F.when(~F.col("source").isin(*DATABASES) & F.col("predicate").isin("credited_on", "member_of", "released_by", "recorded_at"), F.filter(F.coalesce("corroborated", none), lambda x: x.isin("musicbrainz", "discogs"))).otherwise(none)
    every = F.array_distinct(F.concat("db", F.coalesce("_m", none), F.coalesce("_c", none), backed))
    return out.withColumn("db", every).drop("_band", "_person", "_m", "_on", "_who", "_c")


def independence(claims: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds support: the different origins that say the same as a claim, its own source aside, and those that corroborate it.

    Two claims say the same if their predicates are equal and their names are the same on both sides. Claims are facts
    (predicate, subject, object) with their origins first, so a fact that very many claims state is one row of the join. A note
    and a page that it cites are one origin: neither supports the other.
    """
    fact = ["predicate", "s", "o"]
    url = F.split(F.coalesce("source_url", F.lit("")), "#")[0]
    note = F.when(F.col("kind") == "map", F.split(F.element_at(F.split("source_url", "#"), -1), r"\.")[0])
    told = claims.select("claim", "predicate", F.col("subject.key").alias("s"), F.col("object.key").alias("o"), "source", F.concat("source", F.coalesce(F.concat(F.lit(":"), "via"), F.lit(""))).alias("origin"), url.alias("url"), note.alias("note"))
    cites = notes.select("note", "cites")
    told = kept(told.join(cites, "note", "left").drop("note"), "told")
    origins = told.groupBy(*fact).agg(F.collect_set(F.struct("source", "origin", "url", "cites")).alias("origins"))
    origins = kept(origins, "facts")
    names = origins.select(F.col("s").alias("key")).union(origins.select("o")).distinct().where("key <> ''")
    others = kept(same_names(names.withColumnRenamed("key", "a"), names.withColumnRenamed("key", "b")), "same-names").toDF("key", "other")
    facts = origins.select(*fact)
    alike = facts.join(others.select(F.col("key").alias("s"), F.col("other").alias("s2")), "s").join(others.select(F.col("key").alias("o"), F.col("other").alias("o2")), "o")
    met = alike.join(origins.select("predicate", F.col("s").alias("s2"), F.col("o").alias("o2"), "origins"), ["predicate", "s2", "o2"])
    every = met.groupBy(*fact).agg(F.array_distinct(F.flatten(F.collect_list("origins"))).alias("_origins"))
    joined = told.join(every, fact, "left")
    none = F.array().cast("array<string>")
    cited = lambda cites, url: (url != "") & F.coalesce(F.array_contains(cites, url), F.lit(False))
    backs = F.filter(F.coalesce("_origins", F.array().cast(every.schema["_origins"].dataType)), lambda d: (d["source"] != F.col("source")) & ~cited(F.col("cites"), d["url"]) & ~cited(d["cites"], F.col("url")))
    support = joined.select("claim", F.array_distinct(F.transform(backs, lambda d: d["origin"])).alias("_support"))
    out = claims.join(support, "claim", "left")
    return out.withColumn("support", F.array_union(F.coalesce("_support", none), F.coalesce("corroborated", none))).drop("_support")


def verify(claims: DataFrame, lookups: Lookups) -> DataFrame:
    """claim, fails, support (sorted arrays), confidence, status (rejected, accepted, ask or unread) of every claim."""
    out = structure(claims, lookups.predicates)
    out = evidence(out, lookups.pages, lookups.notes)
    out = dates(out, lookups.years, lookups.album_years)
    out = kept(databases(out, lookups.recordings, lookups.members, lookups.credits), "claims")
    out = independence(out, lookups.notes).join(lookups.reader.groupBy("claim").agg(F.min("verdict").alias("verdict")), "claim", "left")
    support = F.array_sort(F.array_union("support", "db"))
    fails = F.array_sort(F.concat("fails", _names(reader_rejects=F.col("verdict").isin(*REJECTING))))
    first = reduce(lambda rest, kv: F.when((F.col("kind") == kv[0][0]) & (F.col("basis") == kv[0][1]), kv[1]).otherwise(rest), BASE.items(), F.lit(OTHER_BASE))
    confidence = F.when(F.col("kind") == "owner", 1.0).otherwise(F.least(first + STEP * F.size(support), F.lit(CAP)))
    read = F.col("kind").isin(*DATABASES, "extracted", "owner") | F.startswith("evidence", F.lit("field:")) | F.col("verdict").eqNullSafe("SUPPORTS")
    partial = F.col("verdict").eqNullSafe("PARTIAL")
    status = F.when(F.size(fails) > 0, "rejected").when(read | (partial & (F.size("db") > 0)), "accepted").when(partial, "ask").otherwise("unread")
    return out.select("claim", fails.alias("fails"), support.alias("support"), F.when(F.size(fails) > 0, 0.0).otherwise(F.round(confidence, 2)).alias("confidence"), status.alias("status"))


def settled(batches: DataFrame, verified: DataFrame) -> DataFrame:
    """batch, settled: whether a batch (batch, claim) has claims and none of them is left open (unread or ask)."""
    joined = batches.join(verified.select("claim", "status"), "claim")
    return joined.groupBy("batch").agg((~F.bool_or(F.col("status").isin("unread", "ask"))).alias("settled"))
