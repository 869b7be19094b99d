"""Identity, run placement, entry resolution, claims and the smaller catalogue steps, over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions import lineups as shows
from ..operators import catalog, merging
from ..sources import tables
from ..sources.tables import table
from .registry import query

C = F.col


@query("""WITH known AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN 'm' || (s_suppkey % 50) END AS mbid, 'k' || (s_suppkey % 40) AS key FROM supplier),
c AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'm' || (o_custkey % 60) END AS mbid, 'k' || (o_custkey % 70) AS key FROM orders),
bm AS (SELECT mbid, min(id) AS by_mbid FROM known WHERE mbid IS NOT NULL GROUP BY 1), sp AS (SELECT key, min(id) AS spare FROM known WHERE mbid IS NULL GROUP BY 1),
f AS (SELECT c.mbid, c.key, by_mbid FROM c LEFT JOIN bm USING (mbid) WHERE c.mbid IS NOT NULL),
tk AS (SELECT key, mbid, spare FROM (SELECT key, min(mbid) AS mbid FROM f WHERE by_mbid IS NULL GROUP BY 1) JOIN sp USING (key)),
s AS (SELECT f.mbid, f.key, coalesce(by_mbid, spare) AS id, CASE WHEN by_mbid IS NOT NULL THEN 'mbid' WHEN spare IS NOT NULL THEN 'promoted' ELSE 'created' END AS how FROM f LEFT JOIN tk ON tk.mbid = f.mbid AND tk.key = f.key),
fr AS (SELECT key, min(id) AS free FROM known WHERE mbid IS NULL AND id NOT IN (SELECT spare FROM tk) GROUP BY 1),
sg AS (SELECT key, min(id) AS single FROM (SELECT key, id FROM known WHERE mbid IS NOT NULL UNION ALL SELECT key, id FROM s WHERE how <> 'mbid') GROUP BY 1 HAVING count(*) = 1)
SELECT * FROM s UNION ALL SELECT NULL, c.key, coalesce(free, single), CASE WHEN free IS NOT NULL THEN 'key' WHEN sg.key IS NOT NULL THEN 'single' ELSE 'created' END FROM c LEFT JOIN fr ON fr.key = c.key LEFT JOIN sg ON sg.key = c.key WHERE c.mbid IS NULL""")
def identity_assignment(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    known = s.select(C("s_suppkey").alias("id"), F.when(C("s_suppkey") % 3 != 0, F.concat(F.lit("m"), C("s_suppkey") % 50)).alias("mbid"), F.concat(F.lit("k"), C("s_suppkey") % 40).alias("key"))
    credits = table(spark, sf_dir, "orders").select(F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit("m"), C("o_custkey") % 60)).alias("mbid"), F.concat(F.lit("k"), C("o_custkey") % 70).alias("key"))
    return catalog.assign_identities(credits, known)


_BARE = "regexp_replace({}, '^an? (.)', '\\1')"
_WORDS = "list_sort(string_split({}, ' '))"


@query(f"""WITH r AS (SELECT DISTINCT p_brand || '/' || p_name AS run, p_brand AS artist, p_name AS key FROM part), g AS (SELECT DISTINCT p_brand || '/' || p_type AS group_id, p_brand AS artist, string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] AS key, p_type FROM part),
gg AS (SELECT artist || '/' || key AS group_id, artist, key FROM g UNION SELECT artist || '/' || string_split(key, ' ')[2], artist, string_split(key, ' ')[2] FROM g)
SELECT DISTINCT run, group_id FROM r JOIN gg USING (artist) WHERE r.key = gg.key OR starts_with({_BARE.format('gg.key')}, {_BARE.format('r.key')} || ' ') OR starts_with({_BARE.format('r.key')}, {_BARE.format('gg.key')} || ' ') OR {_WORDS.format(_BARE.format('r.key'))} = {_WORDS.format(_BARE.format('gg.key'))}
UNION SELECT run, group_id FROM r JOIN gg ON r.key = gg.key""")
def fuzzy_candidates(spark, sf_dir):
    """Names against names with their words turned round, and against first words alone."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    turned = part.select(C("p_brand").alias("artist"), F.concat_ws(" ", words[1], words[0]).alias("key")).union(part.select("p_brand", words[0])).distinct()
    groups = turned.select(F.concat_ws("/", "artist", "key").alias("group_id"), "artist", "key")
    runs = part.select(F.concat_ws("/", "p_brand", "p_name").alias("run"), C("p_brand").alias("artist"), C("p_name").alias("key")).distinct()
    return catalog.candidate_groups(runs, groups)


_ENTRIES = """e AS (SELECT p_partkey AS entry, p_name AS name, p_brand AS brand, p_size AS year, p_type AS kind FROM part), k AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS k_year, p_type AS k_kind FROM part WHERE p_retailprice > 950),
a AS (SELECT * FROM e JOIN k USING (name, brand)), b AS (SELECT * FROM (SELECT *, abs(year - k_year) <= 1 AS keep, bool_or(abs(year - k_year) <= 1) OVER (PARTITION BY entry) AS any_keep FROM a) WHERE keep OR NOT any_keep),
d AS (SELECT * FROM (SELECT * EXCLUDE (keep, any_keep), kind = k_kind AS keep, bool_or(kind = k_kind) OVER (PARTITION BY entry) AS any_keep FROM b) WHERE keep OR NOT any_keep),
res AS (SELECT e.entry, o.found, e.name, e.brand FROM e LEFT JOIN (SELECT entry, min(id) AS found FROM d GROUP BY 1 HAVING count(DISTINCT id) = 1) o USING (entry))"""


def _entries(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entries = part.select(C("p_partkey").alias("entry"), C("p_name").alias("name"), C("p_brand").alias("brand"), C("p_size").alias("year"), C("p_type").alias("kind"))
    known = part.where("p_retailprice > 950").select(C("p_partkey").alias("id"), C("p_name").alias("name"), C("p_brand").alias("brand"), C("p_size").alias("k_year"), C("p_type").alias("k_kind"))
    return entries, catalog.resolve_entries(entries, known, ["name", "brand"], [F.abs(C("year") - C("k_year")) <= 1, C("kind") == C("k_kind")])


@query("WITH " + _ENTRIES + " SELECT entry, found FROM res")
def list_entry_resolution(spark, sf_dir):
    return _entries(spark, sf_dir)[1]


@query("WITH " + _ENTRIES + " SELECT entry, CASE WHEN count(DISTINCT found) OVER (PARTITION BY name, brand) = 1 THEN min(found) OVER (PARTITION BY name, brand) END AS found FROM res")
def settled_entries(spark, sf_dir):
    entries, found = _entries(spark, sf_dir)
    return catalog.settle(entries.select("entry", "name", "brand").join(found, "entry"), ["name", "brand"], "found").select("entry", "found")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_discount, l_shipdate, o_orderdate FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) - 1 AS support FROM c GROUP BY ALL),
f AS (SELECT c.*, support, list_sort(list_filter([CASE WHEN NOT coalesce(l_quantity BETWEEN 1 AND 45, false) THEN 'structure' END, CASE WHEN NOT coalesce(l_discount > 0, false) THEN 'evidence' END, CASE WHEN NOT coalesce(l_shipdate >= o_orderdate, false) THEN 'dates' END], lambda x: x IS NOT NULL)) AS fails FROM c JOIN n USING (l_partkey, l_returnflag))
SELECT l_orderkey, l_linenumber, array_to_string(fails, ',') AS fails, support, CASE WHEN len(fails) > 0 THEN 0.0 ELSE round(least(0.6 + 0.1 * support, 0.95), 6) END AS confidence, CASE WHEN len(fails) > 0 THEN 'rejected' WHEN support > 0 THEN 'accepted' ELSE 'open' END AS status FROM f""")
def claim_verification(spark, sf_dir):
    """Structure, evidence and dates of every claim, and how many other sources say the same of its subject."""
    dates = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("l_orderkey"), "o_orderdate")
    claims = catalog.independent_support(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"], "l_suppkey").join(dates, "l_orderkey", "left")
    fails = catalog.failures(structure=C("l_quantity").between(1, 45), evidence=C("l_discount") > 0, dates=C("l_shipdate") >= C("o_orderdate"))
    bad = F.size("f") > 0
    return claims.withColumn("f", fails).select(
        "l_orderkey", "l_linenumber", F.array_join("f", ",").alias("fails"), "support",
        F.when(bad, 0.0).otherwise(F.round(F.least(0.6 + 0.1 * C("support"), F.lit(0.95)), 6)).alias("confidence"), F.when(bad, "rejected").when(C("support") > 0, "accepted").otherwise("open").alias("status"),
    )


@query("""SELECT l_orderkey AS album, 'part' || l_partkey AS subject, l_returnflag AS predicate, count(*) AS claims, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS tracks FROM lineitem GROUP BY ALL""")
def facts_claims(spark, sf_dir):
    """Claims from facts given as one JSON document for each album: parsed by a schema, unnested, grouped."""
    fact = F.struct(C("l_linenumber").alias("track"), F.struct(F.concat(F.lit("part"), "l_partkey").alias("name")).alias("subject"), C("l_returnflag").alias("role"))
    pages = table(spark, sf_dir, "lineitem").groupBy(C("l_orderkey").alias("album")).agg(F.to_json(F.struct(F.collect_list(fact).alias("facts"))).alias("body"))
    facts = pages.select("album", F.explode(F.from_json("body", "facts array<struct<track:int,subject:struct<name:string>,role:string>>")["facts"]).alias("f"))
    grouped = facts.groupBy("album", C("f.subject.name").alias("subject"), C("f.role").alias("predicate"))
    return grouped.agg(F.count("*").alias("claims"), F.array_join(F.array_sort(F.collect_list("f.track")), ",").alias("tracks"))


@query("""WITH s AS (SELECT l_orderkey, min(l_shipdate) AS first_sale, count(*) AS sales, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1) SELECT l_orderkey, first_sale, sales, CASE WHEN low = high THEN CAST(CAST(floor(low) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor(low) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(high) AS BIGINT) AS VARCHAR) END AS prices FROM s""")
def presale_lists(spark, sf_dir):
    """A sorted list of sales from JSON, its first one, and the range of prices as text."""
    sale = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("starts"), C("l_extendedprice").alias("price"))
    raw = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(sale)).alias("body"))
    sales = raw.select("l_orderkey", F.array_sort(F.from_json("body", "array<struct<starts:string,price:double>>")).alias("s"))
    price = lambda f: F.floor(f(F.transform("s", lambda x: x["price"]))).cast("long").cast("string")
    low, high = price(F.array_min), price(F.array_max)
    return sales.select("l_orderkey", F.to_timestamp_ntz(C("s")[0]["starts"], F.lit("yyyy-MM-dd")).alias("first_sale"), F.size("s").cast("long").alias("sales"), F.when(F.size(F.array_distinct(F.transform("s", lambda x: x["price"]))) == 1, low).otherwise(F.concat_ws("-", low, high)).alias("prices"))


@query("""SELECT event_id, user_id, coalesce(nullif(trim(event_type), ''), 'none') AS title, CAST(coalesce(CASE WHEN event_id % 2 = 0 THEN k END, CASE WHEN event_id % 3 = 0 THEN k * 1000 END) AS BIGINT) AS duration_ms FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def parse_listens(spark, sf_dir):
    """Nested documents of listens, as an API sends them, read by a declared schema: milliseconds, else seconds by thousand."""
    k = F.get_json_object("props", "$.k").cast("long")
    info = F.struct(F.when(C("event_id") % 2 == 0, k).alias("duration_ms"), F.when(C("event_id") % 3 == 0, k).alias("duration"))
    sent = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", C("user_id").alias("listener"), F.struct(F.concat(F.lit(" "), "event_type").alias("track_name"), info.alias("additional_info")).alias("track_metadata"))).alias("body"))
    read = sent.select(F.from_json("body", "event_id long, listener long, track_metadata struct<track_name:string,additional_info:struct<duration_ms:long,duration:long>>").alias("l"))
    given = C("l.track_metadata.additional_info")
    return read.select("l.event_id", C("l.listener").alias("user_id"), F.coalesce(F.nullif(F.trim("l.track_metadata.track_name"), F.lit("")), F.lit("none")).alias("title"), F.coalesce(given["duration_ms"], given["duration"] * 1000).alias("duration_ms"))


@query("""SELECT p_partkey, p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND p_size > 0 AS eligible, p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND p_size > 0 AND p_brand <> 'Brand#1' AND p_retailprice < 1500 AS strict FROM part""")
def eligible_two_rules(spark, sf_dir):
    """The rule of sessions (a kind with a tracklist) and the stricter one of listings (no compilation, no box)."""
    eligible = C("p_type").isin("ECONOMY", "STANDARD", "PROMO") & (C("p_size") > 0)
    return table(spark, sf_dir, "part").select("p_partkey", eligible.alias("eligible"), (eligible & (C("p_brand") != "Brand#1") & (C("p_retailprice") < 1500)).alias("strict"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 30 AS k FROM lineitem), n AS (SELECT o_orderkey, unnest([o_custkey % 30, (o_custkey + 1) % 30]) AS k FROM orders),
m AS (SELECT l_orderkey, l_linenumber, count(n.k) AS notes FROM t LEFT JOIN n ON n.o_orderkey = t.l_orderkey AND n.k = t.k GROUP BY ALL)
SELECT l_orderkey, l_linenumber, notes FROM m UNION ALL SELECT o_orderkey, NULL, count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.l_orderkey = n.o_orderkey AND t.k = n.k) GROUP BY 1""")
def track_notes(spark, sf_dir):
    """Notes by track title; what names no track of the album is the album's own."""
    tracks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (C("l_partkey") % 30).alias("k"))
    notes = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("l_orderkey"), F.explode(F.array(C("o_custkey") % 30, (C("o_custkey") + 1) % 30)).alias("k"))
    counted = tracks.join(notes.groupBy("l_orderkey", "k").agg(F.count("*").alias("n")), ["l_orderkey", "k"], "left")
    rest = notes.join(tracks, ["l_orderkey", "k"], "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("notes"))
    return counted.groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.coalesce("n", F.lit(0))).alias("notes")).unionByName(rest.withColumn("l_linenumber", F.lit(None).cast("int")))


@query("""SELECT DISTINCT p_name || ' w/ ' || lower(p_brand) || ' (live)' AS title, p_name AS headliner, lower(p_brand) AS support FROM part""")
def lineups(spark, sf_dir):
    titles = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" w/ "), F.lower("p_brand"), F.lit(" (live)")).alias("title")).distinct()
    return titles.withColumn("l", shows.split_lineup_udf("title")).select("title", C("l")[0].alias("headliner"), C("l")[1].alias("support"))


@query("""WITH c AS (SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN ' (' || p_type || ')' ELSE '' END AS raw FROM part)
SELECT p_partkey, CASE WHEN contains(raw, '(') THEN trim(string_split(raw, '(')[1]) ELSE raw END AS name, CASE WHEN contains(raw, '(') THEN replace(string_split(raw, '(')[2], ')', '') END AS note FROM c""")
def performers(spark, sf_dir):
    """Performers as listed, parted from the note in brackets behind them; each different name is cleaned once."""
    raw = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(C("p_size") % 3 == 0, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise("")).alias("raw"))
    cleaned = raw.select("raw").distinct().withColumn("c", shows.clean_performer_udf("raw"))
    return raw.join(cleaned, "raw").select("p_partkey", "c.name", "c.note")


_EVENINGS = ("A tribute to {}", "{} in concert", "The music of {}", "{}", "{} vs the rest", "40 years of {}", "{} with friends")


@query("WITH t AS (SELECT s_suppkey, s_suppkey % 7 AS k FROM supplier) SELECT s_suppkey, k NOT IN (3, 6) AS no_artist FROM t")
def evenings_without_artist(spark, sf_dir):
    """Evenings of music by others, told from shows of artists by their titles."""
    title = F.element_at(F.array(*(F.replace(F.lit(t), F.lit("{}"), C("s_name")) for t in _EVENINGS)), (C("s_suppkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", shows.non_artist_event_udf(title).alias("no_artist"))


@query("""WITH c AS (SELECT o_orderkey, 'clerk ' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN ', ' || o_orderstatus WHEN 1 THEN ' feat. ' || o_orderstatus ELSE '' END AS credit, CASE WHEN o_orderkey % 5 = 0 THEN ['', ' ' || o_orderpriority, 'x'] END AS names, CASE WHEN o_orderkey % 2 = 0 THEN 'clerk ' || o_custkey END AS album, o_orderpriority FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority WHEN starts_with(credit, album || ',') THEN album ELSE string_split(credit, ' feat. ')[1] END AS artist FROM c""")
def primary_artists(spark, sf_dir):
    """The artist that a credit is filed under."""
    key = C("o_orderkey")
    clerk = F.concat(F.lit("clerk "), "o_custkey")
    credit = F.concat(clerk, F.when(key % 3 == 0, F.concat(F.lit(", "), "o_orderstatus")).when(key % 3 == 1, F.concat(F.lit(" feat. "), "o_orderstatus")).otherwise(""))
    names = F.when(key % 5 == 0, F.array(F.lit(""), F.concat(F.lit(" "), "o_orderpriority"), F.lit("x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.primary_artist(credit, names, F.when(key % 2 == 0, clerk)).alias("artist"))


@query("""WITH g AS (SELECT DISTINCT p_partkey, trim(unnest(string_split_regex(p_name || ', ' || p_type || ' (old); x', '[,;]'))) AS raw FROM part) SELECT DISTINCT p_partkey, lower(trim(regexp_replace(raw, '\\s*\\([^)]*\\)', '', 'g'))) AS genre FROM g WHERE raw <> 'x'""")
def split_genres(spark, sf_dir):
    """Genres as written, apart: brackets go, listed words are dropped, one spelling each."""
    raw = F.split(F.concat("p_name", F.lit(", "), "p_type", F.lit(" (old); x")), "[,;]")
    cleaned = F.transform(raw, lambda g: F.lower(F.trim(F.regexp_replace(g, r"\s*\([^)]*\)", ""))))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.filter(cleaned, lambda g: ~g.isin("", "x")))).alias("genre"))


@query("""SELECT page_id, contains(replace(replace(lower(html), '"', ''), '''', ''), lower(regexp_extract(url, '^[a-z]+://([^/.:]+)', 1))) AS on_page FROM pages""")
def names_on_pages(spark, sf_dir):
    """Whether a name stands on its page, quote marks aside."""
    bare = F.translate(F.lower("html"), "\"'", "")
    return table(spark, sf_dir, "pages").select("page_id", F.contains(bare, F.lower(F.regexp_extract("url", r"^[a-z]+://([^/.:]+)", 1))).alias("on_page"))


@query("""WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN ' (19' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || ')' WHEN p_size % 3 = 1 THEN ': ' || p_type ELSE ' [' || p_brand || ']' END AS title FROM part)
SELECT p_partkey, unnest(list_distinct([title, regexp_replace(title, '\\s*\\((19|20)\\d\\d\\)$', ''), regexp_replace(title, '\\s*\\[[^\\]]+\\]\\s*$', ''), coalesce(nullif(regexp_extract(title, '\\[([^\\]]+)\\]\\s*$', 1), ''), title), trim(string_split(title, ':')[1])])) AS variant FROM t""")
def title_variants(spark, sf_dir):
    """Spellings to search a title by: without its year, both halves of a title with another one in brackets, the part before a colon."""
    size = C("p_size")
    title = F.concat("p_name", F.when(size % 3 == 0, F.concat(F.lit(" (19"), F.lpad((size % 100).cast("string"), 2, "0"), F.lit(")"))).when(size % 3 == 1, F.concat(F.lit(": "), "p_type")).otherwise(F.concat(F.lit(" ["), "p_brand", F.lit("]"))))
    t = C("title")
    forms = F.array(t, F.regexp_replace(t, r"\s*\((19|20)\d\d\)$", ""), F.regexp_replace(t, r"\s*\[[^\]]+\]\s*$", ""), F.nullif(F.regexp_extract(t, r"\[([^\]]+)\]\s*$", 1), F.lit("")), F.trim(F.split_part(t, F.lit(":"), F.lit(1))))
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title")).select("p_partkey", F.explode(F.array_distinct(F.array_compact(forms))).alias("variant"))


@query("""SELECT o_orderkey, concat_ws(' · ', 'rank ' || (o_orderkey % 50 + 1), CASE WHEN o_orderstatus = 'F' THEN 'finished' END, year(o_orderdate) || CASE WHEN o_totalprice > 200000 THEN ' (long)' ELSE '' END) AS line FROM orders""")
def why_lines(spark, sf_dir):
    parts = (F.concat(F.lit("rank "), C("o_orderkey") % 50 + 1), F.when(C("o_orderstatus") == "F", "finished"), F.concat(F.year("o_orderdate"), F.when(C("o_totalprice") > 200_000, " (long)").otherwise("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" · ", *parts).alias("line"))


@query(r"""SELECT s_suppkey, regexp_replace(s_name || ' (' || s_nationkey || ')', '\s*\(\d+\)$', '') AS name, regexp_extract('https://www.example.org/release/' || s_suppkey, '/(master|release|artist)/', 1) AS kind, regexp_replace(s_name || '+x', '([+\-!(){}\[\]^"~*?:\\/#])', '\\\1', 'g') AS escaped FROM supplier""")
def clean_credits(spark, sf_dir):
    """Number suffixes of credits, kinds of links by path, signs escaped for a search."""
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.regexp_replace(F.concat("s_name", F.lit(" ("), "s_nationkey", F.lit(")")), r"\s*\(\d+\)$", "").alias("name"),
        F.regexp_extract(F.parse_url(F.concat(F.lit("https://www.example.org/release/"), "s_suppkey"), F.lit("PATH")), "/(master|release|artist)/", 1).alias("kind"),
        F.regexp_replace(F.concat("s_name", F.lit("+x")), r'([+\-!(){}\[\]^"~*?:\\/#])', r"\\$1").alias("escaped"),
    )


@query("""SELECT p_partkey, nullif(trim(CASE WHEN p_size % 4 = 0 THEN '  ' ELSE p_name || ' ' END), '') AS name, 'q=' || url_encode(p_name || ' & ' || p_brand) AS link FROM part""")
def search_links(spark, sf_dir):
    """Trimmed or null, and a search link with blanks as %20."""
    return table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.trim(F.when(C("p_size") % 4 == 0, "  ").otherwise(F.concat("p_name", F.lit(" ")))), F.lit("")).alias("name"), F.concat(F.lit("q="), F.replace(F.url_encode(F.concat_ws(" & ", "p_name", "p_brand")), F.lit("+"), F.lit("%20"))).alias("link"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-0500' WHEN 2 THEN 'soon' ELSE '19' || strftime(ts, '%y-%m-%d') END AS text, ts FROM events)
SELECT event_id, text, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 5 HOUR END AS at FROM e""")
def lenient_times(spark, sf_dir):
    ts, quarter = C("ts"), C("event_id") % 4
    text = F.when(quarter == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(quarter == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0500"))).when(quarter == 2, F.lit("soon")).otherwise(F.concat(F.lit("19"), F.date_format(ts, "yy-MM-dd")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"), catalog.lenient_time(text).cast("timestamp_ntz").alias("at"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) * 12 WHEN 1 THEN year(o_orderdate) * 12 + month(o_orderdate) - 1 END AS INTEGER) AS months, CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN isodow(o_orderdate) < 5 THEN 5 - isodow(o_orderdate) ELSE 12 - isodow(o_orderdate) END AS INTEGER) AS TIMESTAMP) + INTERVAL 1110 MINUTE AS night FROM orders""")
def partial_dates(spark, sf_dir):
    """Months of dates that may lack parts, and the next Friday evening."""
    third = C("o_orderkey") % 3
    given = F.when(third == 0, F.date_format("o_orderdate", "yyyy")).when(third == 1, F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.months(given).alias("months"), catalog.show_night(C("o_orderdate")).cast("timestamp_ntz").alias("night"))


@query("""SELECT o_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS kinds FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)""")
def kinds_in_order(spark, sf_dir):
    """Different values in the order of their first places."""
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return listed.select("o_custkey", F.array_join(F.array_distinct(F.transform("l", lambda x: x["o_orderpriority"])), ",").alias("kinds"))


@query("""SELECT word, array_to_string(list_sort(list_distinct(list(p_partkey))), ',') AS ids FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1""")
def inverted_index(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("p_partkey")), ",").alias("ids"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def rebuilt_table(spark, sf_dir):
    """A table written twice: the second write replaces all of the first, also when its rows differ."""
    path = f"{tables.shared_folder(spark)}/rebuilt-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    for rows in (orders.limit(3), orders):
        tables.rebuild(rows.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def exported_table(spark, sf_dir):
    """Written as CSV with a header and read back by its schema."""
    path = f"{tables.shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    tables.export_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT 'rollup' AS job, 'ok' AS status, CAST((SELECT count(DISTINCT user_id) FROM events) AS BIGINT) AS rows, NULL AS error UNION ALL SELECT 'broken', 'failed', NULL, 'ValueError: no input'")
def run_ledger(spark, sf_dir):
    """Every run is a row, also one that fails; counts are seen while rows are written."""
    ledger = f"{tables.shared_folder(spark)}/ledger-{uuid.uuid4().hex}"

    def broken():
        raise ValueError("no input")

    tables.record_run(spark, ledger, "rollup", lambda: table(spark, sf_dir, "events").groupBy("user_id").count())
    tables.record_run(spark, ledger, "broken", broken)
    return spark.read.parquet(ledger).select("job", "status", "rows", "error")


@query("""WITH n AS (SELECT DISTINCT c_mktsegment || ' & ' || CASE WHEN c_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'nobody' END AS name FROM customer), p AS (SELECT name, unnest(string_split(name, ' & ')) AS part FROM n)
SELECT name, count(*) AS parts, bool_and(part IN (SELECT c_mktsegment FROM customer)) AS all_known, bool_and(part IN (SELECT c_mktsegment FROM customer)) AS split FROM p GROUP BY 1""")
def lineup_resolution(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    names = customers.select(F.concat("c_mktsegment", F.lit(" & "), F.when(C("c_nationkey") % 2 == 0, "BUILDING").otherwise("nobody")).alias("name")).distinct()
    return catalog.all_parts_known(names, customers.select(C("c_mktsegment").alias("part")), "name")


@query("""WITH t AS (SELECT o_custkey, count(DISTINCT l_partkey) AS tracks, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS heard FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_custkey, heard || ' of ' || tracks AS shown, heard, tracks FROM t""")
def heard_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), C("l_orderkey") == C("o_orderkey"))
    counted = lines.groupBy("o_custkey").agg(F.countDistinct(F.when(C("l_returnflag") == "R", C("l_partkey"))).alias("heard"), F.countDistinct("l_partkey").alias("tracks"))
    return counted.select("o_custkey", F.concat("heard", F.lit(" of "), "tracks").alias("shown"), "heard", "tracks")


@query("""SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS verdict, arg_max(o_orderstatus, o_orderkey) AS answer, count(*) - 1 AS superseded FROM orders GROUP BY 1""")
def verdicts_and_answers(spark, sf_dir):
    """The first verdict stays, the last answer supersedes those before it."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("verdict"), F.max_by("o_orderstatus", "o_orderkey").alias("answer"), (F.count("*") - 1).alias("superseded"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 200 AS subject, o_orderpriority AS predicate, list_filter([CASE WHEN o_totalprice < 1000 THEN 'value' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END], lambda x: x IS NOT NULL) AS problems FROM orders)
SELECT id, array_to_string(problems, ',') AS problems, len(problems) = 0 AND row_number() OVER (PARTITION BY subject, predicate, len(problems) = 0 ORDER BY id) = 1 AS taken FROM c""")
def posted_claims(spark, sf_dir):
    """Posted claims with what is wrong about them; of valid ones of one key the first is taken."""
    key = [(C("o_custkey") % 200).alias("subject"), C("o_orderpriority").alias("predicate")]
    posted = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), *key, F.array_compact(F.array(F.when(C("o_totalprice") < 1000, "value"), F.when(C("o_orderstatus") == "P", "status"))).alias("p"))
    first = posted.where(F.size("p") == 0).groupBy("subject", "predicate").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    return posted.join(first, "id", "left").select("id", F.array_join("p", ",").alias("problems"), F.coalesce("first", F.lit(False)).alias("taken"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 3, l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem""")
def continuous_positions(spark, sf_dir):
    """Tracks of several media (three to a disc here) numbered through."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(C("l_linenumber") / 3).alias("medium"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    return catalog.flat_positions(lines, "l_orderkey", "medium", "place").select("l_orderkey", "l_linenumber", "position")


@query("""WITH x AS (SELECT p_name || '/' || p_brand AS album, count(DISTINCT p_size % 3) AS a, min(p_size % 3) AS x, count(DISTINCT p_size % 3) FILTER (p_type <> 'PROMO' AND p_type <> 'ECONOMY') AS b, min(p_size % 3) FILTER (p_type <> 'PROMO' AND p_type <> 'ECONOMY') AS y FROM part GROUP BY 1)
SELECT album, CASE WHEN a = 1 THEN x WHEN b = 1 THEN y END AS agreed, a > 1 AND b <> 1 AS conflict FROM x""")
def agreed_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("album"), (C("p_size") % 3).alias("n"), C("p_type").isin("PROMO", "ECONOMY").alias("edition"))
    return catalog.agreed_count(rows, "album", "n", "edition")


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_type END AS found, 'old' AS note FROM part), n AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand END AS found, 'new' AS note FROM part WHERE p_partkey % 3 = 0)
SELECT t.id, CASE WHEN n.id IS NULL OR (n.found IS NULL AND t.found IS NOT NULL) THEN t.found ELSE n.found END AS found, CASE WHEN n.id IS NULL OR (n.found IS NULL AND t.found IS NOT NULL) THEN t.note ELSE n.note END AS note FROM t LEFT JOIN n USING (id)""")
def resolution_takes_over(spark, sf_dir):
    """A new outcome replaces the stored one, but 'unresolved' never replaces a resolved one."""
    part = table(spark, sf_dir, "part")
    stored = part.select(C("p_partkey").alias("id"), F.when(C("p_size") > 25, C("p_type")).alias("found"), F.lit("old").alias("note"))
    new = part.where("p_partkey % 3 = 0").select(C("p_partkey").alias("id"), F.when(C("p_size") % 2 == 0, C("p_brand")).alias("found"), F.lit("new").alias("note"))
    return catalog.take_over(stored, new, "id", C("found").isNotNull())


@query("""WITH d AS (SELECT o_custkey % 100 AS album, o_orderpriority AS step, o_orderkey AS id, CAST(o_totalprice AS INTEGER) AS cost FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY step, id) AS place FROM d) SELECT album, step, id, place FROM r WHERE place <= 3""")
def fetch_plan(spark, sf_dir):
    """Of every album the first three pages to fetch, by tier."""
    from ..operators import relational

    pages = table(spark, sf_dir, "orders").select((C("o_custkey") % 100).alias("album"), C("o_orderpriority").alias("step"), C("o_orderkey").alias("id"))
    return relational.top_per(pages, ["album"], 3, F.asc("step"), F.asc("id")).withColumnRenamed("rank", "place")


@query("""SELECT l_orderkey, l_partkey, l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS label FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""")
def claim_labels(spark, sf_dir):
    """Claims of one key once, labelled by album and number."""
    claims = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return claims.withColumn("label", F.concat_ws("-", "l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))))


@query("""WITH h AS (SELECT p_name, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_brand = 'Brand#3' GROUP BY 1), a AS (SELECT DISTINCT p_name AS asked FROM part)
SELECT asked, CASE WHEN n = 1 AND id % 4 <> 0 THEN id END AS id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' WHEN id % 4 = 0 THEN 'held' ELSE 'one' END AS outcome FROM a LEFT JOIN h ON p_name = asked""")
def posted_names(spark, sf_dir):
    """A posted name stands for its only hit, if no other entity holds that already."""
    part = table(spark, sf_dir, "part")
    hits = part.where("p_brand = 'Brand#3'").groupBy(C("p_name").alias("asked")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("hit"))
    held = part.where("p_partkey % 4 = 0").select(C("p_partkey").alias("hit"), F.lit(True).alias("held"))
    found = part.select(C("p_name").alias("asked")).distinct().join(hits, "asked", "left").join(held, "hit", "left")
    one = (C("n") == 1) & C("held").isNull()
    return found.select("asked", F.when(one, C("hit")).alias("id"), F.when(C("n").isNull(), "none").when(C("n") > 1, "several").when(one, "one").otherwise("held").alias("outcome"))


@query("""SELECT url, count(*) AS claims, min(doc) AS first_doc FROM (SELECT d.doc_id AS doc, 'http://x/' || d.source AS url FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL) GROUP BY 1""")
def pages_missing(spark, sf_dir):
    """Pages that are quoted but not stored, by address."""
    quoted = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("http://x/"), "source").alias("url"))
    return quoted.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("url").agg(F.count("*").alias("claims"), F.min("doc_id").alias("first_doc"))


@query("""WITH f AS (SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 0 THEN 'quote' END, CASE WHEN p_size % 3 = 0 THEN 'page' END, CASE WHEN p_size % 5 = 0 THEN 'dates' END], lambda x: x IS NOT NULL) AS fails FROM part) SELECT p_partkey, len(fails) > 0 AND len(list_filter(fails, lambda x: x NOT IN ('quote', 'page'))) = 0 AS reopened FROM f""")
def reopened_claims(spark, sf_dir):
    """Claims that fail for want of evidence only are tried again."""
    fails = catalog.failures(quote=C("p_size") % 2 != 0, page=C("p_size") % 3 != 0, dates=C("p_size") % 5 != 0)
    evidence = F.array(F.lit("quote"), F.lit("page"))
    return table(spark, sf_dir, "part").select("p_partkey", ((F.size(fails) > 0) & (F.size(F.array_except(fails, evidence)) == 0)).alias("reopened"))


@query("""WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS place FROM part GROUP BY ALL) SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY place) AS position FROM f""")
def generated_list(spark, sf_dir):
    """A list written anew: each key at its first place, positions without gaps."""
    first = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("at"))
    return first.select("p_brand", "p_name", F.row_number().over(Window.partitionBy("p_brand").orderBy("at")).alias("position"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-06-01') SELECT s_suppkey, l_suppkey IS NOT NULL AS upcoming, row_number() OVER (PARTITION BY s_nationkey ORDER BY l_suppkey IS NOT NULL DESC, s_acctbal DESC, s_suppkey) AS place FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey""")
def venue_order(spark, sf_dir):
    """Venues with shows to come first, by place."""
    soon = table(spark, sf_dir, "lineitem").where("l_shipdate > timestamp '1998-06-01'").select(C("l_suppkey").alias("s_suppkey"), F.lit(True).alias("up")).distinct()
    venues = table(spark, sf_dir, "supplier").join(soon, "s_suppkey", "left").withColumn("upcoming", C("up").isNotNull())
    return venues.select("s_suppkey", "upcoming", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("upcoming"), F.desc("s_acctbal"), "s_suppkey")).alias("place"))


@query("""SELECT DISTINCT lower(p_name) AS raw, p_brand FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 1) UNION SELECT DISTINCT upper(p_name), p_brand FROM part WHERE upper(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 1)""")
def alias_dimension(spark, sf_dir):
    """All spellings of a name that are no alias yet."""
    part = table(spark, sf_dir, "part")
    spellings = part.select(F.lower("p_name").alias("raw"), "p_brand").union(part.select(F.upper("p_name"), "p_brand")).distinct()
    return spellings.join(part.where("p_size = 1").select(F.lower("p_name").alias("raw")), "raw", "left_anti")


@query("""WITH r AS (SELECT c_custkey, min(o_orderdate) AS tried, count(o_orderkey) AS tries FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, CASE WHEN tried IS NULL THEN 'never' ELSE 'again' END AS why FROM r WHERE tried IS NULL OR (tries < 3 AND tried < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY)""")
def pending_work(spark, sf_dir):
    """What was never tried, or seldom and long enough ago; now is a parameter."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(C("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("tried"), F.count("*").alias("tries"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    due = C("tried").isNull() | ((C("tries") < 3) & (C("tried") < F.expr("timestamp_ntz '1998-01-01' - interval 30 days")))
    return rows.where(due).select("c_custkey", F.when(C("tried").isNull(), "never").otherwise("again").alias("why"))


@query("""WITH p AS (SELECT n_nationkey AS lane, unnest(string_split(CAST(n_regionkey AS VARCHAR) || ', ' || CAST(n_nationkey % 7 AS VARCHAR), ',')) AS raw FROM nation), t AS (SELECT lane, CAST(trim(raw) AS INTEGER) AS parent FROM p) SELECT DISTINCT lane, parent, parent IN (SELECT r_regionkey FROM region) AS known FROM t""")
def lane_parents(spark, sf_dir):
    """Parents from a comma list, and whether the file has them."""
    lanes = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("lane"), F.explode(F.split(F.concat_ws(", ", "n_regionkey", C("n_nationkey") % 7), r"\s*,\s*").cast("array<int>")).alias("parent")).distinct()
    regions = table(spark, sf_dir, "region").select(C("r_regionkey").cast("int").alias("parent"), F.lit(True).alias("k"))
    return lanes.join(regions, "parent", "left").select("lane", "parent", C("k").isNotNull().alias("known"))


@query("""WITH m AS (SELECT p_partkey AS gone, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS keep FROM part), f AS (SELECT gone AS old_id, keep AS new_id FROM m WHERE gone <> keep) SELECT new_id, count(*) AS merged, min(old_id) AS first_old FROM f GROUP BY 1""")
def entity_merges(spark, sf_dir):
    """Duplicates merged into the first of them."""
    part = table(spark, sf_dir, "part")
    keep = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("keep"))
    pairs = part.join(keep, ["p_name", "p_brand"]).where("p_partkey <> keep").select("keep", C("p_partkey").alias("gone"))
    return merging.closure(pairs).groupBy("new_id").agg(F.count("*").alias("merged"), F.min("old_id").alias("first_old"))


@query("""WITH g AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS genre FROM part), n AS (SELECT genre, count(DISTINCT p_partkey) AS albums FROM g GROUP BY 1), h AS (SELECT genre, count(DISTINCT l_partkey) AS heard FROM g JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY 1),
s AS (SELECT genre, albums, coalesce(heard, 0) AS heard, coalesce(heard, 0) / albums AS share FROM n LEFT JOIN h USING (genre)), k AS (SELECT *, CASE WHEN share >= 0.5 THEN 'near' WHEN share >= 0.2 THEN 'adjacent' ELSE 'stretch' END AS kind FROM s)
SELECT kind, arg_min(genre, md5('2024-W05:' || genre)) AS genre, count(*) AS candidates FROM k GROUP BY 1""")
def genre_of_week(spark, sf_dir):
    """A genre of each kind, by how much of it was heard; the draw hangs on the week only."""
    genres = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("genre"))
    heard = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber = 1").select(C("l_partkey").alias("p_partkey"), F.lit(1).alias("h")).distinct()
    shares = genres.join(heard, "p_partkey", "left").groupBy("genre").agg((F.countDistinct(F.when(C("h") == 1, C("p_partkey"))) / F.countDistinct("p_partkey")).alias("share"))
    kinds = shares.select("genre", F.when(C("share") >= 0.5, "near").when(C("share") >= 0.2, "adjacent").otherwise("stretch").alias("kind"))
    return kinds.groupBy("kind").agg(F.min_by("genre", F.md5(F.concat(F.lit("2024-W05:"), "genre"))).alias("genre"), F.count("*").alias("candidates"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM a),
p AS (SELECT o_custkey, min(o_orderdate) AS next_sale FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' GROUP BY 1), g AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS shows FROM a GROUP BY 1)
SELECT b.o_custkey, b.o_orderkey AS best, next_sale, shows, round(ln(b.o_totalprice + 1) * power(0.5, (2000 - year(b.o_orderdate)) / 2.0), 6) AS score FROM b LEFT JOIN p USING (o_custkey) JOIN g USING (o_custkey) WHERE r = 1""")
def show_listing(spark, sf_dir):
    """Per venue its best performer, the next sale, all shows in order, and a score that halves in two years."""
    orders = table(spark, sf_dir, "orders")
    live = orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.min_by(F.struct("o_orderkey", "o_totalprice", "o_orderdate"), F.struct(-C("o_totalprice"), "o_orderkey")).alias("b"), F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("shows"))
    sale = orders.where("o_orderdate > timestamp_ntz '1997-01-01'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("next_sale"))
    score = F.log1p("b.o_totalprice") * F.pow(F.lit(0.5), (2000 - F.year("b.o_orderdate")) / 2.0)
    return live.join(sale, "o_custkey", "left").select("o_custkey", C("b.o_orderkey").alias("best"), "next_sale", "shows", F.round(score, 6).alias("score"))
