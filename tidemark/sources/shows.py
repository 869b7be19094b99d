"""Shows from pages and from answers of interfaces: linked data in scripts, records in attributes, microdata on cards, nested
JSON. All parsers give rows of one schema; what can't be read is left out, never guessed, and one broken block costs only itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What all parsers give, besides the page's own id.
SHOW = {
    "source": "string", "source_id": "string", "url": "string", "starts_at": "timestamp", "title": "string", "venue": "string", "venue_slug": "string", "address": "string", "latitude": "double", "longitude": "double",
    "performers": "array<string>", "structured": "boolean", "price": "string", "cancelled": "boolean", "presales": "array<struct<name:string,start:timestamp,end:timestamp>>",
}

# How pages mark scripts, attributes, links and properties, and the fields of records and answers.
SCRIPT = r'(?s)<script type="application/ld\+json">(.*?)</script>'
ATTRIBUTE = r'data-shows?="([^"]+)"'
META = r'<meta itemprop="(\w+)"(?: datetime="[^"]*")? content="([^"]*)"'
PERMALINK = r'data-permalink="(/events/[^"]+)"'
VENUE_LINK = r'<a href="/venues/([^"]+)" itemprop="url"><span itemprop="name">([^<]*)<'
TITLE = r'itemprop="name" class="title">([^<]*)<'
_EVENT = "struct<`@type`:string,url:string,name:string,startDate:string,eventStatus:string,location:struct<name:string,url:string,address:string,geo:struct<latitude:string,longitude:string>>,performer:array<struct<name:string>>,offers:struct<price:string>>"
_RECORD = "struct<id:string,starts_at:string,price:string,venue:struct<slug:string,name:string,full_address:string,latitude:string,longitude:string>,cached_bands:array<struct<name:string,slug:string>>>"
_ANSWER = """struct<_embedded:struct<events:array<struct<id:string,name:string,url:string,dates:struct<start:struct<dateTime:string,localDate:string>,status:struct<code:string>>,
sales:struct<presales:array<struct<name:string,startDateTime:string,endDateTime:string>>>,priceRanges:array<struct<min:double,max:double>>,
_embedded:struct<venues:array<struct<id:string,name:string,postalCode:string,address:struct<line1:string>,city:struct<name:string>,state:struct<stateCode:string>,location:struct<latitude:string,longitude:string>>>,attractions:array<struct<id:string,name:string>>>>>>>"""


def plain(c: Column) -> Column:
    """Text as read: the common entities resolved, blanks made one; null for nothing."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&nbsp;|&#160;", " "), ("&amp;", "&")):
        c = F.regexp_replace(c, entity, sign)
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def moment(c: Column) -> Column:
    """A time with any offset, or none (UTC); null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def _names(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(c, lambda p: plain(p["name"])), lambda n: n.isNotNull()), F.array().cast("array<string>"))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def _show(page_id: str, **columns: Column) -> list[Column]:
    return [F.col(page_id), *(columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in SHOW.items())]


def _rows(blocks: DataFrame, block: str, kind: str) -> DataFrame:
    """One row `r` for each record of JSON blocks that hold one record or an array of them; broken blocks give none."""
    is_list = F.startswith(F.trim(block), F.lit("["))
    many = F.when(is_list, F.from_json(block, f"array<{kind}>")).otherwise(F.array(F.from_json(block, kind)))
    return blocks.withColumn("r", F.explode(many)).where("r is not null").drop(block)


def linked_data(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """Events in scripts of linked data (JSON-LD), one row for each, first of its address on a page."""
    scripts = F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))
    found = _rows(pages.select(page_id, F.explode(scripts).alias("b")), "b", _EVENT).where(F.col("r")["@type"].isin("MusicEvent", "Event"))
    r = F.col("r")
    source_id = F.regexp_extract(r["url"], r"/(\w+)$", 1)
    geo = r["location"]["geo"]
    rows = found.select(*_show(
        page_id, source=F.lit("linked data"), source_id=source_id, url=r["url"], starts_at=moment(r["startDate"]), title=plain(r["name"]), venue=plain(r["location"]["name"]), venue_slug=F.regexp_extract(r["location"]["url"], r"/([^/]+)$", 1),
        address=plain(r["location"]["address"]), latitude=geo["latitude"].try_cast("double"), longitude=geo["longitude"].try_cast("double"), performers=_names(r["performer"]), structured=F.lit(True), price=r["offers"]["price"], cancelled=F.coalesce(F.contains(r["eventStatus"], F.lit("Cancelled")), F.lit(False)),
    ))
    return rows.where("starts_at is not null and source_id <> ''").dropDuplicates([page_id, "source_id"])


def embedded_records(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """Records that pages carry in data-show and data-shows attributes."""
    held = F.regexp_extract_all(html, F.lit(ATTRIBUTE), F.lit(1))
    blocks = pages.select(page_id, F.explode(held).alias("b")).withColumn("b", F.regexp_replace(F.regexp_replace("b", "&quot;", '"'), "&amp;", "&"))
    found = _rows(blocks, "b", _RECORD)
    r, v = F.col("r"), F.col("r.venue")
    names = _names(r["cached_bands"])
    rows = found.select(*_show(
        page_id, source=F.lit("record"), source_id=r["id"], url=F.concat(F.lit("/shows/"), r["id"]), starts_at=moment(r["starts_at"]), title=F.array_join(names, ", "), venue=plain(v["name"]), venue_slug=v["slug"],
        address=plain(v["full_address"]), latitude=v["latitude"].try_cast("double"), longitude=v["longitude"].try_cast("double"), performers=names, structured=F.lit(True), price=r["price"], cancelled=F.lit(False),
    ))
    return rows.where("starts_at is not null and venue_slug <> ''")


def cards(pages: DataFrame, page_id: str, html: str, start: str = '<div class="event-card') -> DataFrame:
    """Event cards with microdata: an address, a name, a venue and properties in meta tags."""
    split = pages.select(page_id, F.posexplode(F.split(html, start)).alias("i", "card")).where("i > 0")
    meta = F.regexp_extract_all("card", F.lit(META), F.lit(1))
    values = F.regexp_extract_all("card", F.lit(META), F.lit(2))
    # Of a property that a card has twice the last one counts.
    pairs = F.arrays_zip(meta.alias("k"), values.alias("v"))
    tagged = split.withColumn("m", F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"]))))
    one = lambda pattern, n=1: F.nullif(F.regexp_extract("card", pattern, n), F.lit(""))
    m = F.col("m")
    link = one(PERMALINK)
    rows = tagged.select(*_show(
        page_id, source=F.lit("card"), source_id=link, url=link, starts_at=moment(m["startDate"]), title=plain(one(TITLE)), venue=plain(one(VENUE_LINK, 2)), venue_slug=one(VENUE_LINK),
        address=plain(_joined(m["streetAddress"], m["addressLocality"], F.trim(F.concat_ws(" ", m["addressRegion"], m["postalCode"])))), latitude=m["latitude"].try_cast("double"), longitude=m["longitude"].try_cast("double"), performers=F.array(), structured=F.lit(False), cancelled=F.lit(False),
    ))
    return rows.where("starts_at is not null and source_id is not null and title is not null and venue_slug is not null")


def answers(bodies: DataFrame, page_id: str, body: str) -> DataFrame:
    """Events of an interface's nested JSON answers, one row each; attractions are the line-up where there are any."""
    read = bodies.select(page_id, F.from_json(body, _ANSWER.replace("\n", "")).alias("a"))
    e = F.col("e")
    events = read.select(page_id, F.explode("a._embedded.events").alias("e"))
    v = F.get(e["_embedded"]["venues"], F.lit(0))
    ranges = F.filter(F.coalesce(e["priceRanges"], F.array().cast("array<struct<min:double,max:double>>")), lambda p: p["min"].isNotNull())
    low, high = F.array_min(F.transform(ranges, lambda p: p["min"])), F.array_max(F.transform(ranges, lambda p: F.coalesce(p["max"], p["min"])))
    dollars = lambda c: F.concat(F.lit("$"), F.format_string("%.0f", F.bround(c, 0)))
    price = F.when(high > 0, F.when(low == high, dollars(low)).otherwise(F.concat(dollars(low), F.lit("–"), dollars(high))))
    presales = F.transform(F.coalesce(e["sales"]["presales"], F.array().cast("array<struct<name:string,startDateTime:string,endDateTime:string>>")), lambda p: F.struct(moment(p["startDateTime"]).alias("start"), F.coalesce(plain(p["name"]), F.lit("Presale")).alias("name"), moment(p["endDateTime"]).alias("end")))
    ordered = F.transform(F.array_sort(F.filter(presales, lambda p: p["start"].isNotNull())), lambda p: F.struct(p["name"].alias("name"), p["start"].alias("start"), p["end"].alias("end")))
    rows = events.select(*_show(
        page_id, source=F.lit("answer"), source_id=e["id"], url=F.coalesce(e["url"], F.lit("")), starts_at=moment(e["dates"]["start"]["dateTime"]), title=plain(e["name"]), venue=plain(v["name"]), venue_slug=v["id"],
        address=plain(_joined(v["address"]["line1"], v["city"]["name"], F.concat_ws(" ", v["state"]["stateCode"], v["postalCode"]))), latitude=v["location"]["latitude"].try_cast("double"), longitude=v["location"]["longitude"].try_cast("double"),
        performers=_names(e["_embedded"]["attractions"]), structured=F.coalesce(F.size(e["_embedded"]["attractions"]) > 0, F.lit(False)), price=price, cancelled=F.coalesce(e["dates"]["status"]["code"] == "cancelled", F.lit(False)), presales=ordered,
    ))
    return rows.where("starts_at is not null and venue_slug is not null")


def listens(bodies: DataFrame, body: str) -> DataFrame:
    """Listens of an interface's nested JSON: time, names and ids as submitted; without a time, an artist or a track there is no listen."""
    kind = """struct<listened_at:bigint,recording_msid:string,track_metadata:struct<artist_name:string,track_name:string,release_name:string,
additional_info:struct<duration_ms:bigint,duration:double,music_service:string,media_player:string,submission_client:string,release_artist_name:string,artist_names:array<string>>,
mbid_mapping:struct<artists:array<struct<artist_credit_name:string,artist_mbid:string>>,recording_mbid:string,release_group_mbid:string>>>""".replace("\n", "")
    r = bodies.select(F.from_json(body, kind).alias("r"))
    meta, info, mapped = F.col("r.track_metadata"), F.col("r.track_metadata.additional_info"), F.col("r.track_metadata.mbid_mapping")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = F.get(F.filter(F.coalesce(mapped["artists"], F.array().cast("array<struct<artist_credit_name:string,artist_mbid:string>>")), lambda a: text(a["artist_credit_name"]).isNotNull()), F.lit(0))
    rows = r.select(
        F.timestamp_seconds("r.listened_at").alias("listened_at"), text(meta["artist_name"]).alias("artist_name"), text(meta["track_name"]).alias("track_name"), text(meta["release_name"]).alias("release_name"), text(info["release_artist_name"]).alias("release_artist"), info["artist_names"].alias("artist_names"),
        text(first["artist_credit_name"]).alias("mapped_artist"), text(first["artist_mbid"]).alias("artist_mbid"), text(mapped["recording_mbid"]).alias("recording_mbid"), text(mapped["release_group_mbid"]).alias("release_group_mbid"),
        F.coalesce(info["duration_ms"], (info["duration"] * 1000).cast("long")).alias("duration_ms"), F.coalesce(text(info["music_service"]), text(info["media_player"]), text(info["submission_client"])).alias("client"),
    )
    return rows.where("listened_at is not null and artist_name is not null and track_name is not null")
