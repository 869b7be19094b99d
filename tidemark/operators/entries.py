"""Entries of lists: namesakes of one list told apart by year, entries found among what is known, and candidates narrowed to one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, variants
from ..sources.tables import kept
from .relational import narrow

#: What is asked for beside years: groups without one, and groups of any.
_UNDATED, _ANY = -1_000_001, -1_000_000


def marked_entries(rows: DataFrame) -> DataFrame:
    """The entries of lists that stay, and their keys: list, artist_key, album_key, row, year.

    rows: list, row (its place), artist_key, album_key, year. Rows without a key go. Of rows of one list with equal keys the
    first stays; a later one is another album only if its year is more than one from those of all that stay, and gets its
    year as a mark on its key. Rows of one list and key, which are few, are folded in order as one array.
    """
    some = rows.where("artist_key <> '' and album_key <> ''").groupBy("list", "artist_key", "album_key").agg(F.array_sort(F.collect_list(F.struct("row", "year"))).alias("same"))
    none = F.array().cast(some.schema["same"].dataType)
    far = lambda a, b: a["year"].isNotNull() & b["year"].isNotNull() & (F.abs(a["year"] - b["year"]) > 1)
    stays = F.aggregate("same", none, lambda found, r: F.when(F.forall(found, lambda x: far(x, r)), F.concat(found, F.array(r))).otherwise(found))
    each = some.select("list", "artist_key", "album_key", F.posexplode(stays).alias("i", "r"))
    marked = F.when(F.col("i") > 0, F.concat("album_key", F.lit(variants.YEAR_MARK), F.col("r.year").cast("string"))).otherwise(F.col("album_key"))
    return each.select("list", "artist_key", marked.alias("album_key"), "r.row", "r.year")


def _keys(names: DataFrame, source: str, udf) -> DataFrame:
    """source, key of every different name, made once each."""
    return names.select(source).distinct().withColumn("key", udf(source)).where("key <> ''")


def _summed_groups(groups: DataFrame) -> DataFrame:
    """artist, key, asked, and the least and greatest group of all and of the mapped ones, for every year that can be asked.

    asked is a year (of groups at most one apart), _UNDATED (groups without a year) or _ANY (groups of any year). One row
    stands for however many groups an artist has of one key and year.
    """
    year = F.col("year").cast("int")
    ways = F.when(year.isNull(), F.array(F.lit(_UNDATED), F.lit(_ANY))).otherwise(F.array(year - 1, year, year + 1, F.lit(_ANY)))
    mapped = F.when(F.col("mapped"), F.col("group_id"))
    by_year = groups.groupBy("artist", "key", "year").agg(F.min("group_id").alias("a"), F.max("group_id").alias("z"), F.min(mapped).alias("ma"), F.max(mapped).alias("mz"))
    asked = by_year.withColumn("asked", F.explode(ways))
    return asked.groupBy("artist", "key", "asked").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("ma").alias("ma"), F.max("mz").alias("mz"))


def find_known(entries: DataFrame, aliases: DataFrame, artists: DataFrame, groups: DataFrame, mapped_only: bool = True) -> DataFrame:
    """entry, found: the only known group of every entry; null where there is none or several.

    entries: entry, raw_artist, raw_album, artist_key, album_key, year. aliases: raw_name, artist. artists: artist, key.
    groups: group_id, artist, key, mapped (boolean), year. An entry's artist is looked up by each variant as an alias and by
    its key, its album by the key of each variant; years must be at most one apart where both are known. Mapped groups come
    before others, which count only without mapped_only and if there is no mapped one.
    """
    return find_known_both(entries, aliases, artists, groups).select("entry", F.col("found" if mapped_only else "found_at_last").alias("found"))


def find_known_both(entries: DataFrame, aliases: DataFrame, artists: DataFrame, groups: DataFrame) -> DataFrame:
    """entry, found (mapped groups only), found_at_last (others where there is no mapped one), in one pass; see find_known.

    Each different spelling is looked up once and joined back to its entries. Groups of one artist, key and year are one row:
    one group is found where the least and the greatest are the same, so pairs of entry and group are never made.
    """
    named = kept(entries.select("raw_artist", "artist_key").distinct(), "named")
    names = named.select("raw_artist", F.explode(variants.artist_variants(F.col("raw_artist"))).alias("name")).distinct()
    by_alias = names.join(aliases.withColumnRenamed("raw_name", "name"), "name").select("raw_artist", "artist")
    by_name = names.join(_keys(names, "name", keys.name_key_udf), "name").join(artists, "key").select("raw_artist", "artist")
    spelt = by_alias.unionByName(by_name)
    of_artist = named.join(spelt, "raw_artist").select("raw_artist", "artist_key", "artist")
    by_key = named.join(artists, F.col("artist_key") == artists["key"]).select("raw_artist", "artist_key", "artist")
    of_artist = kept(of_artist.unionByName(by_key).distinct(), "entry-artists")
    titled = kept(entries.select("raw_album", "album_key").distinct(), "titled")
    titles = titled.select("raw_album", F.explode(variants.title_variants(F.col("raw_album"), subtitle=False)).alias("title")).distinct()
    of_title = titles.join(_keys(titles, "title", keys.album_key_udf), "title").select("raw_album", "key")
    of_album = kept(titled.join(of_title, "raw_album").select("raw_album", "album_key", "key").unionByName(titled.select("raw_album", "album_key", variants.base_album_key(F.col("album_key")).alias("key"))).distinct(), "entry-albums")
    safe = lambda rows, side, other, *columns: rows.join(side, reduce(lambda x, y: x & y, (rows[c].eqNullSafe(side[c]) for c in columns))).select(*(rows[c] for c in rows.columns), *(side[c] for c in other))
    year = F.col("year").cast("int")
    ways = F.when(year.isNull(), F.array(F.lit(_ANY))).otherwise(F.array(year, F.lit(_UNDATED)))
    # Entries that are written alike and have one year are asked for once.
    wanted = kept(entries.select("raw_artist", "artist_key", "raw_album", "album_key", "year").distinct(), "wanted")
    asked = safe(safe(wanted, of_artist, ["artist"], "raw_artist", "artist_key"), of_album, ["key"], "raw_album", "album_key").withColumn("asked", F.explode(ways))
    met = asked.join(_summed_groups(groups), ["artist", "key", "asked"])
    spelling = ["raw_artist", "artist_key", "raw_album", "album_key", "year"]
    summed = met.groupBy(*spelling).agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("ma").alias("ma"), F.max("mz").alias("mz"))
    mapped = F.when(F.col("ma") == F.col("mz"), F.col("ma"))
    last = F.when(F.col("ma").isNotNull(), mapped).when(F.col("a") == F.col("z"), F.col("a"))
    answers = kept(summed.select(*spelling, mapped.alias("found"), last.alias("found_at_last")), "answers")
    same = reduce(lambda x, y: x & y, (entries[c].eqNullSafe(answers[c]) for c in spelling))
    return entries.join(answers, same, "left").select(entries["entry"], "found", "found_at_last")


def choose(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """entry, status, found (ids, ascending) after narrowing: resolved (one), ambiguous (those alike) or unresolved (none).

    entries: entry, year. candidates: entry, id, exact (boolean), year, secondary (array), kind. In turn, and only where
    something survives: exact titles, years at most one apart (where the entry has one), no secondary kinds, albums.
    """
    rows = candidates.dropDuplicates(["entry", "id"]).join(entries.select("entry", F.col("year").alias("own_year")), "entry")
    near = F.col("own_year").isNotNull() & (F.abs(F.col("year") - F.col("own_year")) <= 1)
    left = narrow(rows, ["entry"], F.col("exact"), near, F.size(F.coalesce("secondary", F.array().cast("array<string>"))) == 0, F.col("kind") == "Album")
    found = left.groupBy("entry").agg(F.array_sort(F.collect_set("id")).alias("found"))
    size = F.size("found")
    status = F.when(size == 1, "resolved").when(size > 1, "ambiguous").otherwise("unresolved")
    return entries.select("entry").join(found, "entry", "left").select("entry", status.alias("status"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
