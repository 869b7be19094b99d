"""Shows read from pages and from answers of interfaces. The pages table holds no events, so each page gets some that follow from its row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import shows
from ..sources.tables import table
from .registry import query

C = F.col


def _text(template: str):
    """A template with {page_id} and {day} (two digits) filled in from the row."""
    c = F.replace(F.lit(template), F.lit("{page_id}"), C("page_id").cast("string"))
    return F.replace(c, F.lit("{day}"), F.lpad((C("page_id") % 28 + 1).cast("string"), 2, "0"))


_SCRIPT = '<script type="application/ld+json">[{"@type":"MusicEvent","url":"https://x.example/shows/{page_id}","name":"Night &amp; day  {page_id}","startDate":"2031-05-{day}T20:00:00-0500","location":{"name":"Hall {page_id}","url":"/venues/hall-{page_id}","geo":{"latitude":"41.5","longitude":"none"}},"performer":[{"name":"Oto"},{"name":" "},{"name":"Lio &#39;B&#39;"}],"offers":{"price":"$10"}},{"@type":"Place","url":"https://x.example/shows/0","startDate":"2031-05-01"},{"@type":"MusicEvent","url":"https://x.example/shows/{page_id}","startDate":"2031-05-{day}"}]</script><script type="application/ld+json">{broken</script>'
_RECORD = '<div data-show="{&quot;id&quot;:&quot;r{page_id}&quot;,&quot;starts_at&quot;:&quot;2031-06-{day}T19:30:00Z&quot;,&quot;price&quot;:&quot;free&quot;,&quot;venue&quot;:{&quot;slug&quot;:&quot;attic&quot;,&quot;name&quot;:&quot;The Attic&quot;,&quot;full_address&quot;:&quot;1 Street&quot;,&quot;latitude&quot;:&quot;1.25&quot;,&quot;longitude&quot;:&quot;-2.5&quot;},&quot;cached_bands&quot;:[{&quot;name&quot;:&quot;Ada&quot;},{&quot;name&quot;:&quot;Bo&quot;}]}"></div>'
_CARD = '<div class="event-card"></div><div class="event-card" data-permalink="/events/{page_id}"><span itemprop="name" class="title">Card {page_id}</span><a href="/venues/cellar" itemprop="url"><span itemprop="name">Cellar</span></a><meta itemprop="startDate" datetime="x" content="2031-07-{day}T18:00:00+02:00"><meta itemprop="streetAddress" content="2 Road"><meta itemprop="addressRegion" content="RG"><meta itemprop="postalCode" content="123"><meta itemprop="latitude" content="3.5"></div>'
_DAY = "lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')"


@query(f"""SELECT page_id, 'linked data' AS source, CAST(page_id AS VARCHAR) AS source_id, CAST('2031-05-' || {_DAY} || ' 20:00:00' AS TIMESTAMP) + INTERVAL 5 HOUR AS starts_at, 'Night & day ' || page_id AS title, 'Hall ' || page_id AS venue, 'hall-' || page_id AS venue_slug, NULL AS address, 41.5::DOUBLE AS latitude, NULL::DOUBLE AS longitude, 'Oto|Lio ''B''' AS performers, '$10' AS price FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'record', 'r' || page_id, CAST('2031-06-' || {_DAY} || ' 19:30:00' AS TIMESTAMP), 'Ada, Bo', 'The Attic', 'attic', '1 Street', 1.25, -2.5, 'Ada|Bo', 'free' FROM pages WHERE page_id % 3 <> 1
UNION ALL SELECT page_id, 'card', '/events/' || page_id, CAST('2031-07-' || {_DAY} || ' 18:00:00' AS TIMESTAMP) - INTERVAL 2 HOUR, 'Card ' || page_id, 'Cellar', 'cellar', '2 Road, RG 123', 3.5, NULL, '', NULL FROM pages WHERE page_id % 3 <> 2""")
def page_shows(spark, sf_dir):
    """Shows that pages hold as linked data, as records in attributes and as cards, in one schema."""
    html = F.concat("html", F.when(C("page_id") % 3 == 0, _text(_SCRIPT)).otherwise(""), F.when(C("page_id") % 3 != 1, _text(_RECORD)).otherwise(""), F.when(C("page_id") % 3 != 2, _text(_CARD)).otherwise(""))
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    every = shows.linked_data(pages, "page_id", "html").unionByName(shows.embedded_records(pages, "page_id", "html")).unionByName(shows.cards(pages, "page_id", "html"))
    return every.select("page_id", "source", "source_id", C("starts_at").cast("timestamp_ntz").alias("starts_at"), "title", "venue", "venue_slug", "address", "latitude", "longitude", F.array_join("performers", "|").alias("performers"), "price")


_ANSWER = '{"_embedded":{"events":[{"id":"e{page_id}","name":"Answer {page_id}","url":"u","dates":{"start":{"dateTime":"2031-08-{day}T01:00:00Z"},"status":{"code":"cancelled"}},"sales":{"presales":[{"name":"","startDateTime":"2031-02-02T00:00:00Z"},{"name":"Fans","startDateTime":"2031-02-01T00:00:00Z","endDateTime":"2031-02-03T00:00:00Z"},{"name":"never"}]},"priceRanges":[{"min":20},{"min":10,"max":35}],"_embedded":{"venues":[{"id":"v1","name":"Arena","city":{"name":"Town"},"state":{"stateCode":"ST"},"postalCode":"9"}],"attractions":[{"name":"Oto"}]}},{"id":"none","dates":{"start":{}}},{"id":"homeless","dates":{"start":{"dateTime":"2031-08-01T01:00:00Z"}},"_embedded":{"venues":[]}}]}}'


@query(f"""SELECT page_id, 'e' || page_id AS source_id, CAST('2031-08-' || {_DAY} || ' 01:00:00' AS TIMESTAMP) AS starts_at, 'Arena' AS venue, 'Town, ST 9' AS address, 'Oto' AS performers, '$10–$35' AS price, true AS cancelled, 'Fans 2031-02-01;Presale 2031-02-02' AS presales FROM pages""")
def answered_shows(spark, sf_dir):
    """Shows in an interface's nested answers: line-up, prices as a range, presales by their start."""
    found = shows.answers(table(spark, sf_dir, "pages").select("page_id", _text(_ANSWER).alias("body")), "page_id", "body")
    sales = F.array_join(F.transform("presales", lambda p: F.concat_ws(" ", p["name"], p["start"].cast("date"))), ";")
    return found.select("page_id", "source_id", C("starts_at").cast("timestamp_ntz").alias("starts_at"), "venue", "address", F.array_join("performers", "|").alias("performers"), "price", "cancelled", sales.alias("presales"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'mapped ' || user_id WHEN 1 THEN 'own ' || user_id ELSE 'raw ' || user_id END AS artist, CASE WHEN event_id % 3 = 0 THEN 'm' || user_id END AS mbid, 'track ' || event_id AS track, epoch_ms(date_trunc('second', ts)) // 1000 AS second, CASE WHEN event_id % 2 = 0 THEN 1500 ELSE 250 END::BIGINT AS duration_ms, 'player' AS client FROM events WHERE event_id % 7 <> 0""")
def parsed_listens(spark, sf_dir):
    """Listens from nested JSON: the mapped artist, else the first one submitted, else the credit without guests; those without a track are none."""
    from ..functions import keys

    user, e = C("user_id").cast("string"), C("event_id")
    mapped = F.when(e % 3 == 0, F.concat(F.lit(',"mbid_mapping":{"artists":[{"artist_credit_name":" "},{"artist_credit_name":"mapped '), user, F.lit('","artist_mbid":"m'), user, F.lit('"}]}'))).otherwise("")
    names = F.when(e % 3 == 1, F.concat(F.lit(',"artist_names":[" ","own '), user, F.lit('"]'))).otherwise("")
    length = F.when(e % 2 == 0, F.lit('"duration":1.5')).otherwise('"duration_ms":250')
    track = F.when(e % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("track "), e.cast("string")))
    body = F.concat(F.lit('{"listened_at":'), F.floor(F.unix_micros(C("ts").cast("timestamp")) / 1_000_000).cast("string"), F.lit(',"track_metadata":{"artist_name":"raw '), user, F.lit(' feat. Other","track_name":"'), track, F.lit('","additional_info":{"media_player":"player",'), length, names, F.lit("}"), mapped, F.lit("}}"))
    found = shows.listens(table(spark, sf_dir, "events").select(body.alias("body")), "body")
    artist = F.coalesce("mapped_artist", keys.primary_artist(C("artist_name"), C("artist_names"), C("release_artist")))
    return found.select(F.regexp_extract("track_name", r"(\d+)", 1).cast("long").alias("event_id"), artist.alias("artist"), C("artist_mbid").alias("mbid"), C("track_name").alias("track"), F.unix_seconds("listened_at").alias("second"), "duration_ms", "client")
