"""List entries and extracted claims over the test tables: namesakes, what is known, candidates, nested answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entries, extraction
from ..sources.tables import table
from .registry import query

C = F.col


@query("""WITH RECURSIVE r AS (SELECT o_orderstatus AS list, 'a' || (o_custkey % 60) AS artist_key, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'b' || (o_orderkey % 15) END AS album_key, o_orderkey AS row, CASE WHEN o_orderkey % 9 > 0 THEN CAST(1960 + o_orderkey * 7 % 40 AS INTEGER) END AS year FROM orders),
e AS (SELECT *, row_number() OVER (PARTITION BY list, artist_key, album_key ORDER BY row) AS rn FROM r WHERE album_key <> ''),
w AS (SELECT list, artist_key, album_key, rn, row, year, [year] AS had, true AS stays FROM e WHERE rn = 1
  UNION ALL SELECT e.list, e.artist_key, e.album_key, e.rn, e.row, e.year, CASE WHEN e.year IS NOT NULL AND NOT list_contains(list_transform(w.had, lambda y: y IS NULL OR abs(y - e.year) <= 1), true) THEN list_append(w.had, e.year) ELSE w.had END, e.year IS NOT NULL AND NOT list_contains(list_transform(w.had, lambda y: y IS NULL OR abs(y - e.year) <= 1), true)
  FROM w JOIN e ON e.list = w.list AND e.artist_key = w.artist_key AND e.album_key = w.album_key AND e.rn = w.rn + 1)
SELECT list, artist_key, CASE WHEN rn = 1 THEN album_key ELSE album_key || ' #' || year END AS album_key, row, year FROM w WHERE stays""")
def entries_marked(spark, sf_dir):
    """Entries of lists that stay: namesakes of other years are albums of their own, marked with their year."""
    key = C("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        C("o_orderstatus").alias("list"), F.concat(F.lit("a"), C("o_custkey") % 60).alias("artist_key"), F.when(key % 50 == 0, "").otherwise(F.concat(F.lit("b"), key % 15)).alias("album_key"),
        key.alias("row"), F.when(key % 9 > 0, 1960 + key * 7 % 40).cast("int").alias("year"),
    )
    return entries.marked_entries(rows)


_KNOWN = """g AS (SELECT p_partkey AS group_id, p_partkey % 30 AS artist, p_name AS title, p_size % 3 > 0 AS mapped, CASE WHEN p_size % 5 > 0 THEN 1990 + p_size % 25 END AS year FROM part),
e AS (SELECT o_orderkey AS entry, o_custkey % 30 AS a, o_orderkey * 3 % 200 AS k, CASE WHEN o_orderkey % 4 > 0 THEN 1990 + o_orderkey % 25 END AS year FROM orders),
t AS (SELECT e.*, p_name AS title FROM e JOIN part ON p_partkey = k),
x AS (SELECT t.entry, count(*) FILTER (mapped) AS m, min(group_id) FILTER (mapped) AS mg, count(*) AS n, min(group_id) AS ng FROM t JOIN g ON g.artist = t.a AND g.title = t.title AND (g.year IS NULL OR t.year IS NULL OR abs(g.year - t.year) <= 1) WHERE NOT (entry % 6 = 5 AND a % 7 <> 3) GROUP BY 1)"""


@query("WITH " + _KNOWN + " SELECT e.entry, CASE WHEN m = 1 THEN mg END AS found, CASE WHEN m = 1 THEN mg WHEN m = 0 AND n = 1 THEN ng END AS found_at_last FROM e LEFT JOIN x USING (entry)")
def entries_found(spark, sf_dir):
    """Entries among what is known, whichever way their artist and title are written; mapped groups first."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    number = lambda n: F.concat(F.lit("artist "), n)
    groups = part.select(C("p_partkey").alias("group_id"), (C("p_partkey") % 30).alias("artist"), C("p_name").alias("key"), (C("p_size") % 3 > 0).alias("mapped"), F.when(C("p_size") % 5 > 0, 1990 + C("p_size") % 25).alias("year"))
    artists = groups.select("artist").distinct().select("artist", number(C("artist")).alias("key"))
    aliases = artists.where("artist % 7 = 3").select(F.concat(F.lit("Alias of "), "artist").alias("raw_name"), "artist")
    raw = orders.select(C("o_orderkey").alias("entry"), (C("o_custkey") % 30).alias("a"), (C("o_orderkey") * 3 % 200).alias("p_partkey"), F.when(C("o_orderkey") % 4 > 0, 1990 + C("o_orderkey") % 25).alias("year"))
    raw = raw.join(part.select("p_partkey", "p_name"), "p_partkey", "left")
    e = C("entry") % 6
    artist = number(C("a"))
    named = F.when(e == 0, F.concat(F.upper(artist), F.lit(" (UK)"))).when(e == 1, F.concat(F.lit("別名 ["), artist, F.lit("]"))).when(e == 2, F.concat(artist, F.lit(" [別名]"))).when(e == 3, F.concat(F.lit(" "), artist, F.lit(" (2)"))).when(e == 5, F.concat(F.lit("Alias of "), "a")).otherwise(artist)
    title = C("p_name")
    titled = F.when(e == 0, F.concat(title, F.lit(" (1999)"))).when(e == 1, F.concat(title, F.lit(" (Blue One)"))).when(e == 2, F.concat(F.lit("題 ["), title, F.lit("]"))).when(e == 3, F.concat(title, F.lit(" (Deluxe Edition)"))).otherwise(title)
    listed = raw.select("entry", named.alias("raw_artist"), titled.alias("raw_album"), F.lit("").alias("artist_key"), F.lit("").alias("album_key"), "year")
    return entries.find_known_both(listed, aliases, artists, groups)


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS entry, l_partkey AS id, first(l_returnflag = 'R' ORDER BY l_linenumber, l_suppkey) AS exact, first(year(l_shipdate) ORDER BY l_linenumber, l_suppkey) AS year, first(l_linestatus = 'O' ORDER BY l_linenumber, l_suppkey) AS live, first(l_linenumber % 2 = 1 ORDER BY l_linenumber, l_suppkey) AS album FROM lineitem GROUP BY ALL),
e AS (SELECT o_orderkey AS entry, CASE WHEN o_custkey % 3 > 0 THEN year(o_orderdate) END AS own FROM orders),
a AS (SELECT c.*, own, max(exact) OVER (PARTITION BY entry) AS any1 FROM c JOIN e USING (entry)), b AS (SELECT * FROM a WHERE exact OR NOT any1),
b2 AS (SELECT *, coalesce(abs(year - own) <= 1, false) AS near FROM b), d AS (SELECT *, max(near) OVER (PARTITION BY entry) AS any2 FROM b2), f AS (SELECT * FROM d WHERE near OR NOT any2),
g AS (SELECT *, max(NOT live) OVER (PARTITION BY entry) AS any3 FROM f), h AS (SELECT * FROM g WHERE NOT live OR NOT any3), i AS (SELECT *, max(album) OVER (PARTITION BY entry) AS any4 FROM h), j AS (SELECT entry, list_sort(list(id)) AS ids FROM i WHERE album OR NOT any4 GROUP BY 1)
SELECT entry, CASE len(ids) WHEN 1 THEN 'resolved' ELSE CASE WHEN ids IS NULL THEN 'unresolved' ELSE 'ambiguous' END END AS status, coalesce(array_to_string(ids, ','), '') AS found FROM e LEFT JOIN j USING (entry)""")
def entries_chosen(spark, sf_dir):
    """Candidates narrowed in turn, only where something survives: exact titles, near years, no live records, albums."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    first = lines.groupBy(C("l_orderkey").alias("entry"), C("l_partkey").alias("id")).agg(F.min_by(F.struct("l_returnflag", "l_shipdate", "l_linestatus", "l_linenumber"), F.struct("l_linenumber", "l_suppkey")).alias("l"))
    found = first.select("entry", "id", (C("l.l_returnflag") == "R").alias("exact"), F.year("l.l_shipdate").alias("year"), F.when(C("l.l_linestatus") == "O", F.array(F.lit("Live"))).otherwise(F.array().cast("array<string>")).alias("secondary"), F.when(C("l.l_linenumber") % 2 == 1, "Album").otherwise("EP").alias("kind"))
    asked = orders.select(C("o_orderkey").alias("entry"), F.when(C("o_custkey") % 3 > 0, F.year("o_orderdate")).alias("year"))
    return entries.choose(asked, found).select("entry", "status", F.array_join("found", ",").alias("found"))


def _filled(template: str):
    """A template with {k} and {name} filled in from a row of part."""
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), C("p_partkey").cast("string")), F.lit("{name}"), C("p_name"))


_RELEASE = '{"id":"r{k}","relations":[{"target-type":"artist","type":"producer","attributes":["co"],"artist":{"id":"p1","name":"Ada"}},{"target-type":"place","type":"recorded at","place":{"id":"s{k}","name":"Room {k}"}},{"target-type":"place","type":"recorded at","place":{"id":"s{k}","name":"Room {k}"}}],"media":[{"tracks":[{"title":"{name}","recording":{"relations":[{"target-type":"artist","type":"instrument","attributes":["Guitar","guest"],"artist":{"id":"p1","name":"Ada"}},{"target-type":"artist","type":"photography","artist":{"id":"p2","name":"Bo"}},{"target-type":"work","type":"performance","work":{"relations":[{"target-type":"artist","type":"composer","artist":{"id":"w","name":"Cy"}},{"target-type":"artist","type":"publisher","artist":{"id":"x","name":"No"}}]}}]}},{"title":"Another","recording":{"relations":[{"target-type":"artist","type":"vocal","artist":{"id":"p1","name":"Ada"}}]}}]}],"label-info":[{"catalog-number":"C{k}","label":{"id":"l","name":"Label"}},{"catalog-number":"none"}]}'


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name FROM part)
SELECT k AS p_partkey, 'Ada' AS subject, 'credited_on' AS predicate, NULL AS object, 'co-producer|guitar|vocal' AS roles, array_to_string(list_sort([name, 'Another']), '|') AS tracks, NULL AS catalog FROM p
UNION ALL SELECT k, 'Cy', 'credited_on', NULL, 'songwriter', name, NULL FROM p UNION ALL SELECT k, NULL, 'recorded_at', 'Room ' || k, 'recorded at', '', NULL FROM p UNION ALL SELECT k, NULL, 'released_by', 'Label', '', '', 'C' || k FROM p""")
def release_claims(spark, sf_dir):
    """Credits with their tracks, songwriting, places and labels from nested answers on releases."""
    found = extraction.release_claims(table(spark, sf_dir, "part").select("p_partkey", _filled(_RELEASE).alias("body")), "p_partkey", "body")
    return found.select("p_partkey", "subject", "predicate", "object", F.array_join("roles", "|").alias("roles"), F.array_join("tracks", "|").alias("tracks"), "catalog")


_BAND = '{"id":"b{k}","name":"Band {k}","relations":[{"target-type":"artist","type":"member of band","direction":"backward","attributes":["drums"],"begin":"1990","artist":{"id":"m","name":"Member"}},{"target-type":"artist","type":"member of band","direction":"backward","begin":"1999","artist":{"id":"m","name":"Member"}},{"target-type":"artist","type":"tribute","artist":{"id":"z","name":"Z"}}],"area":{"name":"Land"},"begin-area":{"name":"Town {k}"}}'
_CREDITS = '{"url":"u","credits":[{"name":"Dee (3)","role":"Bass [Fretless]"},{"name":"Dee","role":"Vocals"},{"name":"Eve","role":"Artwork By"}],"labels":[{"name":"Tag (2)","catno":"T-{k}"}],"styles":["Dub"]}'
_FACTS = '{"producers":["Fay",""],"engineers_and_mixers":[{"name":"Fay","role":"mixing, Engineer"}],"musicians":[{"name":"Gil","roles":["sax"]},{"name":"Hal","roles":["cover art"]}],"recording_locations":[{"studio_or_place":"Barn {k}","city":"Town"},{"city":"Nowhere"}]}'


@query("""WITH k AS (SELECT p_partkey AS k FROM part) SELECT k AS p_partkey, 'Member' AS subject, 'member_of' AS predicate, 'Band ' || k AS object, 'drums' AS roles FROM k UNION ALL SELECT k, 'Band ' || k, 'based_in', 'Town ' || k, '' FROM k
UNION ALL SELECT k, 'Dee', 'credited_on', NULL, 'bass|vocals' FROM k UNION ALL SELECT k, NULL, 'released_by', 'Tag', '' FROM k UNION ALL SELECT k, NULL, 'has_genre', 'Dub', '' FROM k
UNION ALL SELECT k, 'Fay', 'credited_on', NULL, 'engineer|mixing|producer' FROM k UNION ALL SELECT k, 'Gil', 'credited_on', NULL, 'sax' FROM k UNION ALL SELECT k, NULL, 'recorded_at', 'Barn ' || k, '' FROM k""")
def extracted_claims(spark, sf_dir):
    """Memberships, credits, labels, genres and places from the three other kinds of answers."""
    part = table(spark, sf_dir, "part")
    body = lambda t: part.select("p_partkey", _filled(t).alias("body"))
    every = extraction.artist_claims(body(_BAND), "p_partkey", "body").unionByName(extraction.credit_claims(body(_CREDITS), "p_partkey", "body")).unionByName(extraction.facts_claims(body(_FACTS), "p_partkey", "body"))
    return every.select("p_partkey", "subject", "predicate", "object", F.array_join("roles", "|").alias("roles"))
