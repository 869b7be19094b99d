"""Claims from nested answers of databases and from facts read off pages: who is credited, where, by which label, in which band.

One row for each claim: subject, predicate, object (names), roles, tracks, catalog, source, url. Answers are parsed once, each
kind of relation is one explode, and what several relations say of one person is put together by a partly summed group of names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relations that name what was played, attributes that are no role, who writes works, and what is no work on the music.
PLAYED = ("instrument", "vocal")
NO_ROLE = ("guest", "additional")
WRITES = ("composer", "lyricist", "writer")
NOT_MUSICAL = ("art direction", "artwork", "cover", "design", "illustration", "layout", "liner notes", "photography")

_ARTIST = "struct<id:string,name:string,type:string>"
_RELATION = f"struct<`target-type`:string,type:string,attributes:array<string>,begin:string,direction:string,artist:{_ARTIST},place:struct<id:string,name:string>"
_WORK = f"work:struct<relations:array<struct<`target-type`:string,type:string,artist:{_ARTIST}>>>"
RELEASE = f"struct<id:string,relations:array<{_RELATION}>>,media:array<struct<tracks:array<struct<title:string,recording:struct<relations:array<{_RELATION},{_WORK}>>>>>>>,`label-info`:array<struct<`catalog-number`:string,label:struct<id:string,name:string>>>>"
MEMBERS = f"struct<id:string,name:string,type:string,relations:array<{_RELATION}>>,area:struct<name:string>,`begin-area`:struct<name:string>>"
CREDITS = "struct<url:string,credits:array<struct<name:string,role:string>>,labels:array<struct<name:string,catno:string>>,styles:array<string>>"
FACTS = "struct<producers:array<string>,engineers_and_mixers:array<struct<name:string,role:string>>,musicians:array<struct<name:string,roles:array<string>>>,recording_locations:array<struct<studio_or_place:string,city:string>>>"


def musical(roles: Column) -> Column:
    """Roles in lower case, sorted, each once, without those that are no work on the music."""
    low = F.filter(F.transform(roles, lambda r: F.lower(F.trim(r))), lambda r: (r != "") & ~F.exists(F.array(*map(F.lit, NOT_MUSICAL)), lambda n: F.contains(r, n)))
    return F.array_sort(F.array_distinct(low))


def _claims(rows: DataFrame, key: str, source: str, predicate: str, **columns: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    return rows.select(
        F.col(key), columns.get("subject", empty).alias("subject"), F.lit(predicate).alias("predicate"), columns.get("object", empty).alias("object"),
        columns.get("roles", none).alias("roles"), columns.get("tracks", none).alias("tracks"), columns.get("catalog", empty).alias("catalog"), F.lit(source).alias("source"),
    )


def _roles(rel: Column) -> Column:
    """What a relation says a person did: the instruments or voices, else the relation's name, with "co-" where it says so."""
    plain = F.filter(F.coalesce(rel["attributes"], F.array().cast("array<string>")), lambda a: ~a.isin(*NO_ROLE))
    played = F.when(F.size(plain) > 0, plain).otherwise(F.array(rel["type"]))
    return F.when(rel["type"].isin(*PLAYED), played).otherwise(F.array(F.concat(F.when(F.array_contains(plain, "co"), "co-").otherwise(""), rel["type"])))


def release_claims(releases: DataFrame, key: str, body: str, source: str = "musicbrainz") -> DataFrame:
    """Credits with roles and tracks, songwriting, places and labels of releases (nested JSON in body, one for each key).

    A person credited for the release itself has no tracks; the names of their tracks otherwise, sorted.
    """
    read = releases.select(key, F.from_json(body, RELEASE).alias("r"))
    tracks = read.select(key, F.explode("r.media").alias("m")).select(key, F.explode("m.tracks").alias("t"))
    whole = read.select(key, F.explode("r.relations").alias("rel"), F.lit(None).cast("string").alias("track"))
    each = tracks.select(key, F.explode("t.recording.relations").alias("rel"), F.col("t.title").alias("track"))
    kinds = ("target-type", "type", "attributes", "artist", "place")
    narrow_ = lambda df: df.select(key, "track", *(F.col("rel")[k].alias(k.replace("-", "_")) for k in kinds))
    every = narrow_(whole).unionByName(narrow_(each))
    rel = {k: F.col(k) for k in ("type", "attributes")}
    people = every.where("target_type = 'artist'").select(key, "artist", F.col("track"), _roles(rel).alias("roles"))
    credited = people.groupBy(key, F.col("artist.id").alias("id")).agg(F.min("artist.name").alias("name"), musical(F.flatten(F.collect_set("roles"))).alias("roles"), F.array_sort(F.collect_set("track")).alias("tracks")).where(F.size("roles") > 0)
    out = [_claims(credited, key, source, "credited_on", subject=F.col("name"), roles=F.col("roles"), tracks=F.col("tracks"))]
    works = each.where(F.col("rel")["target-type"] == "work").select(key, "track", F.explode("rel.work.relations").alias("w")).where((F.col("w")["target-type"] == "artist") & F.col("w.type").isin(*WRITES))
    written = works.groupBy(key, F.col("w.artist.id").alias("id")).agg(F.min("w.artist.name").alias("name"), F.array_sort(F.collect_set("track")).alias("tracks"))
    out.append(_claims(written, key, source, "credited_on", subject=F.col("name"), roles=F.array(F.lit("songwriter")), tracks=F.col("tracks")))
    places = every.where("target_type = 'place'").select(key, F.col("place.id").alias("id"), F.col("place.name").alias("name"), "type").dropDuplicates([key, "id", "type"])
    out.append(_claims(places, key, source, "recorded_at", object=F.col("name"), roles=F.array("type")))
    labels = read.select(key, F.explode(F.col("r")["label-info"]).alias("l")).where("l.label is not null")
    out.append(_claims(labels, key, source, "released_by", object=F.col("l.label.name"), catalog=F.col("l")["catalog-number"]))
    return reduce(DataFrame.unionByName, out)


def artist_claims(artists: DataFrame, key: str, body: str, source: str = "musicbrainz") -> DataFrame:
    """Memberships, whichever side the answer is about, and where an artist is from (where it began, else its area)."""
    a = artists.select(key, F.from_json(body, MEMBERS).alias("a"))
    rel = a.select(key, "a.name", F.explode("a.relations").alias("r")).where((F.col("r")["target-type"] == "artist") & (F.col("r.type") == "member of band")).dropDuplicates([key, "r"])
    member = rel.groupBy(key, "name", F.col("r.artist.id").alias("id")).agg(F.min_by("r", F.coalesce("r.begin", F.lit("9"))).alias("r"))
    forward = F.col("r.direction") == "forward"
    out = _claims(member, key, source, "member_of", subject=F.when(forward, F.col("name")).otherwise(F.col("r.artist.name")), object=F.when(forward, F.col("r.artist.name")).otherwise(F.col("name")), roles=F.coalesce("r.attributes", F.array().cast("array<string>")))
    based = a.select(key, F.col("a.name").alias("name"), F.coalesce(F.col("a")["begin-area"]["name"], F.col("a.area.name")).alias("area")).where("area is not null")
    return out.unionByName(_claims(based, key, source, "based_in", subject=F.col("name"), object=F.col("area")))


def credit_claims(answers: DataFrame, key: str, body: str, source: str = "discogs") -> DataFrame:
    """One credit for each person with all roles, one label each with its number, one genre for each style. Numbers behind names
    (namesakes) and notes in brackets behind roles go."""
    d = answers.select(key, F.from_json(body, CREDITS).alias("d"))
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s*\(\d+\)$", ""))
    role = F.trim(F.regexp_replace(F.coalesce("c.role", F.lit("")), r"\s*\[[^\]]*\]", ""))
    people = d.select(key, F.explode("d.credits").alias("c")).select(key, clean(F.col("c.name")).alias("name"), role.alias("role"))
    credited = people.groupBy(key, "name").agg(musical(F.collect_set("role")).alias("roles")).where(F.size("roles") > 0)
    labels = d.select(key, F.explode("d.labels").alias("l"))
    styles = d.select(key, F.explode("d.styles").alias("s"))
    return (
        _claims(credited, key, source, "credited_on", subject=F.col("name"), roles=F.col("roles"))
        .unionByName(_claims(labels, key, source, "released_by", object=clean(F.col("l.name")), catalog=F.col("l.catno")))
        .unionByName(_claims(styles, key, source, "has_genre", object=F.col("s")))
    )


def facts_claims(pages: DataFrame, key: str, body: str, source: str = "page") -> DataFrame:
    """Personnel and places from facts read off a page: roles of producers, engineers and musicians put together by name."""
    f = pages.select(key, F.from_json(body, FACTS).alias("f"))
    none = F.array().cast("array<string>")
    produced = f.select(key, F.explode("f.producers").alias("name"), F.array(F.lit("producer")).alias("roles"))
    engineered = f.select(key, F.explode("f.engineers_and_mixers").alias("e")).select(key, F.col("e.name").alias("name"), F.split(F.coalesce("e.role", F.lit("")), r"\s*,\s*").alias("roles"))
    played = f.select(key, F.explode("f.musicians").alias("m")).select(key, F.col("m.name").alias("name"), F.coalesce("m.roles", none).alias("roles"))
    people = produced.unionByName(engineered).unionByName(played).where("name <> ''")
    credited = people.groupBy(key, "name").agg(musical(F.flatten(F.collect_list("roles"))).alias("roles")).where(F.size("roles") > 0)
    places = f.select(key, F.explode("f.recording_locations").alias("l")).where("l.studio_or_place <> ''")
    return _claims(credited, key, source, "credited_on", subject=F.col("name"), roles=F.col("roles")).unionByName(_claims(places, key, source, "recorded_at", object=F.col("l.studio_or_place")))
