"""Upkeep of the catalogue over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import keys, texts, variants
from ..operators import checks, upkeep
from ..sources import tables
from ..sources.tables import table
from .registry import query

C = F.col


@query("SELECT DISTINCT l_suppkey AS group_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'A' AND l_discount IS NOT NULL")
def connection_candidates(spark, sf_dir):
    """Groups of accepted and resolved entries, each once."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_discount is not null").select(C("l_suppkey").alias("group_id")).distinct()
    return lines.join(table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("group_id")), "group_id")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'old key' WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS reported FROM part""")
def keys_filled(spark, sf_dir):
    """Missing keys filled, one key for each different name; keys that are there stay."""
    size = C("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when((size % 7 != 0) | (size % 3 == 0), F.concat("p_name", F.when(size % 2 == 0, " (Deluxe)").otherwise(""))).alias("name"), F.when(size % 3 == 0, "old key").alias("reported"))
    return upkeep.fill_keys(rows, "name", "reported", keys.album_key_udf("name")).select("p_partkey", "reported")


@query("""SELECT p_partkey, p_name AS stored FROM part WHERE p_size % 4 > 0""")
def titles_rekeyed(spark, sf_dir):
    """Title keys made anew after a change of the rule; only rows whose key differs are given."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" (feat. Other)")).alias("title"), F.when(C("p_size") % 4 == 0, C("p_name")).otherwise(F.concat("p_name", F.lit(" other"))).alias("stored"))
    return upkeep.renew_keys(rows, "title", "stored", keys.title_key_udf("title")).where("changed").select("p_partkey", "stored")


@query("""WITH h AS (SELECT l_suppkey AS home, l_partkey AS title FROM lineitem WHERE l_returnflag = 'R'), l AS (SELECT l_orderkey AS listen, l_suppkey AS home, l_partkey AS title, l_linenumber AS line FROM lineitem WHERE l_returnflag <> 'R')
SELECT listen, line, home, title, EXISTS (SELECT 1 FROM h WHERE h.home = l.home AND h.title = l.title) AS on_list, NOT EXISTS (SELECT 1 FROM h WHERE h.home = l.home) AS unlisted FROM l""")
def placed_or_not(spark, sf_dir):
    """Listens with whether their home lists the title, and whether it has a list at all: what placing, folding and redirects start from."""
    lines = table(spark, sf_dir, "lineitem")
    listed = lines.where("l_returnflag = 'R'").select(C("l_suppkey").alias("home"), C("l_partkey").alias("title")).distinct()
    listens = lines.where("l_returnflag <> 'R'").select(C("l_orderkey").alias("listen"), C("l_linenumber").alias("line"), C("l_suppkey").alias("home"), C("l_partkey").alias("title"))
    on = listens.join(listed.withColumn("on_list", F.lit(True)), ["home", "title"], "left")
    homes = tables.broadcast_if_small(tables.kept(listed.select("home").distinct().withColumn("has", F.lit(True)), "homes"), 500_000)
    return on.join(homes, "home", "left").select("listen", "line", "home", "title", F.coalesce("on_list", F.lit(False)).alias("on_list"), C("has").isNull().alias("unlisted"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'found' ELSE 'unresolved' END AS source, o_orderdate AS tried, CASE WHEN o_orderkey % 5 = 0 THEN 'no match in the database' ELSE 'other' END AS note FROM orders)
SELECT o_orderkey, CASE WHEN source IS NULL THEN 'never' WHEN note LIKE 'no match %' THEN 'reason gone' ELSE 'again' END AS why FROM t WHERE source IS NULL OR (source = 'unresolved' AND (note LIKE 'no match %' OR tried < TIMESTAMP '1996-06-01' - INTERVAL 30 DAY))""")
def pending_retries(spark, sf_dir):
    """What is to be resolved: never tried, tried a month ago, or unresolved for a reason that has gone since."""
    key = C("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 4 == 1, "found").when(key % 4 > 1, "unresolved").alias("source"), C("o_orderdate").alias("tried"), F.when(key % 5 == 0, "no match in the database").otherwise("other").alias("note"))
    return upkeep.due(rows, F.expr("timestamp_ntz '1996-06-01'"), 30, "no match %").select("o_orderkey", "why")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND (p_type = 'PROMO' OR p_size % 4 = 0) THEN 'accepted' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'accepted' END AS review, l_returnflag = 'R' AND (p_type = 'PROMO' OR p_size % 4 = 0) AS restored FROM lineitem JOIN part ON p_partkey = l_partkey""")
def compilations_restored(spark, sf_dir):
    """Entries that were rejected as collections are accepted again: by a flag of their group or by one of its kinds."""
    part = table(spark, sf_dir, "part").select(C("p_partkey").alias("group_id"), (C("p_size") % 4 == 0).alias("flag"), F.array("p_type").alias("kinds"))
    entries = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C("l_partkey").alias("group_id"), F.when(C("l_returnflag") == "R", "rejected").otherwise("accepted").alias("review"))
    known = entries.join(part.select("group_id"), "group_id", "left_semi")
    return upkeep.restore(known, part, C("flag") | F.array_contains("kinds", "PROMO")).select("l_orderkey", "l_linenumber", "review", "restored")


@query("""SELECT o_orderkey, TRY_CAST(raw_year AS INTEGER) AS year, CASE WHEN pr IN ('core', 'wide') THEN pr END AS priority, CASE WHEN g <> '' THEN 'genre=' || g ELSE '' END AS facets FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 1 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS raw_year, CASE o_orderkey % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'wide' WHEN 2 THEN 'odd' ELSE '' END AS pr, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS g FROM orders)""")
def shared_list_rows(spark, sf_dir):
    """Rows of the shared list form as entries: years that can be read, priorities that are known, facets that hold something."""
    key = C("o_orderkey")
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 3 == 0, "n/a").when(key % 3 == 1, "").otherwise(F.year("o_orderdate").cast("string")).alias("year"), F.element_at(F.array(*map(F.lit, ("core", "wide", "odd", ""))), (key % 4 + 1).cast("int")).alias("priority"), F.when(key % 2 == 0, C("o_orderpriority")).otherwise("").alias("genre"))
    facets = F.map_filter(F.create_map(F.lit("genre"), "genre"), lambda _, v: v != "")
    return raw.select("o_orderkey", C("year").try_cast("int").alias("year"), F.when(C("priority").isin("core", "wide"), C("priority")).alias("priority"), F.array_join(F.transform(F.map_entries(facets), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("facets"))


@query("""SELECT DISTINCT date_trunc('week', o_orderdate) AS week, o_custkey AS group_id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-02' AND o_orderdate < TIMESTAMP '1995-03-06'""")
def finished_between(spark, sf_dir):
    """Albums finished in each week of a span, the last day left out."""
    from ..operators.relational import half_open

    done = half_open(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderdate", "1995-01-02", "1995-03-06")
    return done.select(F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("week"), C("o_custkey").alias("group_id")).distinct()


@query("""SELECT s_suppkey AS artist, p_partkey AS group_id FROM supplier JOIN part ON p_partkey % 97 = s_suppkey % 97 WHERE p_size % 2 = 0 AND NOT list_has_any(string_split(p_type || '/' || p_brand, '/'), ['PROMO', 'ECONOMY'])""")
def own_studio_albums(spark, sf_dir):
    """An artist's own albums, without collections and live records."""
    part = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(C("p_partkey").alias("group_id"), F.array("p_type", "p_brand").alias("secondary"))
    own = part.where(~F.arrays_overlap("secondary", F.array(F.lit("PROMO"), F.lit("ECONOMY")))).withColumn("k", C("group_id") % 97)
    return table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("artist"), (C("s_suppkey") % 97).alias("k")).join(own, "k").select("artist", "group_id")


@query("""WITH e AS (SELECT c_custkey AS id, 'm' || (c_custkey % 400) AS mbid, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 300 END AS group_id FROM customer), g AS (SELECT p_partkey AS group_id, 'm' || (p_partkey % 500) AS mbid FROM part),
f AS (SELECT mbid, min(group_id) AS free FROM g WHERE group_id NOT IN (SELECT group_id FROM e WHERE group_id IS NOT NULL) GROUP BY 1), a AS (SELECT min(id) AS id, mbid FROM e WHERE group_id IS NULL GROUP BY mbid)
SELECT e.id, coalesce(e.group_id, free) AS group_id, free IS NOT NULL AS linked FROM e LEFT JOIN (SELECT id, free FROM a JOIN f USING (mbid)) x ON x.id = e.id""")
def entities_linked(spark, sf_dir):
    """Entities get the group of their id in the database, if nobody has it yet."""
    key = C("c_custkey")
    entities = table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("m"), key % 400).alias("mbid"), F.when(key % 5 == 0, key % 300).alias("group_id"))
    groups = table(spark, sf_dir, "part").select(C("p_partkey").alias("group_id"), F.concat(F.lit("m"), C("p_partkey") % 500).alias("mbid"))
    return upkeep.link_entities(entities, groups).select("id", "group_id", "linked")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'discogs' WHEN p_size % 3 = 1 THEN 'map' ELSE 'text' END AS kind, CASE WHEN p_size % 2 = 0 THEN 1900 + p_size END AS year, CASE WHEN p_size % 3 = 0 THEN p_name || '|' || p_brand ELSE p_name END AS names FROM part""")
def claim_helpers(spark, sf_dir):
    """How a claim was found (extractor, else source), the year in a stated date, and all names that an entity has had."""
    size = C("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(size % 3 == 1, "map:a").when(size % 3 == 2, "blog").otherwise("discogs").alias("source"), F.when(size % 2 == 0, F.concat(F.lit("19"), F.lpad(size.cast("string"), 2, "0"), F.lit("-05"))).alias("dated"), F.when(size % 3 == 0, F.array("p_name", "p_brand")).alias("merged"))
    kind = F.when(C("source").isin("musicbrainz", "discogs", "wikidata"), C("source")).when(F.startswith("source", F.lit("map:")), "map").otherwise("text")
    names = F.array_distinct(F.concat(F.array("p_name"), F.coalesce("merged", F.array().cast("array<string>"))))
    return rows.select("p_partkey", kind.alias("kind"), F.substring("dated", 1, 4).try_cast("int").alias("year"), F.array_join(names, "|").alias("names"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'opened' WHEN 1 THEN 'core,opened' WHEN 2 THEN 'opened' ELSE 'core' END AS slices FROM orders""")
def albums_opened(spark, sf_dir):
    """Albums opened without a first import join the slice of opened ones, once."""
    key = C("o_orderkey")
    held = F.when(key % 4 == 1, F.array(F.lit("core"))).when(key % 4 == 2, F.array(F.lit("opened"))).when(key % 4 == 3, F.array(F.lit("core")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", held.alias("slices"), (key % 4 == 3).alias("imported"))
    return upkeep.add_slice(rows, "slices", "opened", ~C("imported")).select("o_orderkey", F.array_join("slices", ",").alias("slices"))


@query("""SELECT p_partkey, array_to_string(list_filter(CASE WHEN p_size % 3 = 0 THEN [p_type] WHEN p_brand = p_type THEN [p_brand] ELSE [p_type, p_brand] END, lambda x: x <> ''), ', ') AS genre, CASE WHEN p_size <= 5 THEN 'core' WHEN p_size <= 20 THEN 'wide' ELSE 'deep' END AS priority FROM part WHERE p_size > 0""")
def lists_converted(spark, sf_dir):
    """A published list in the shared form: genres of two fields merged without those that say nothing, ranks as priorities."""
    size = C("p_size")
    rows = table(spark, sf_dir, "part").where(size > 0)
    return rows.select("p_partkey", upkeep.merged_lists(F.concat("p_type", F.lit(", NA")), F.when(size % 3 == 0, F.lit("NA")).otherwise(F.concat("p_brand", F.lit(" , "), "p_type"))).alias("genre"), upkeep.tier(size, {5: "core", 20: "wide"}, "deep").alias("priority"))


@query("""WITH c AS (SELECT p_brand, count(*) AS albums, count(*) FILTER (p_size > 25) AS covered FROM part GROUP BY 1), l AS (SELECT 2 AS part, p_brand AS at, '| ' || p_brand || ' | ' || albums || ' | ' || covered || ' | ' || CAST(round(100.0 * covered / albums) AS INTEGER) || ' |' AS line FROM c)
SELECT * FROM l UNION ALL VALUES (0, '', '| p_brand | albums | covered | percent |'), (1, '', '|---|---|---|---|')""")
def coverage_report(spark, sf_dir):
    """Coverage as the lines of a table in a written report."""
    counted = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("albums"), F.count_if(C("p_size") > 25).alias("covered"))
    return upkeep.report_table(counted.withColumn("percent", F.round(100.0 * C("covered") / C("albums")).cast("int")), "p_brand", ["albums", "covered", "percent"])


@query("""SELECT n_regionkey AS page, count(*) AS lines, min('- ' || n_name) AS first_line FROM nation GROUP BY 1""")
def exported_pages(spark, sf_dir):
    """Pages of text and JSON lines written and read back."""
    path = f"{tables.shared_folder(spark)}/export-{uuid.uuid4().hex}"
    nation = table(spark, sf_dir, "nation")
    tables.export_pages(nation.withColumn("line", F.concat(F.lit("- "), "n_name")), f"{path}/pages", "n_regionkey", "line")
    tables.export_json(nation, f"{path}/json")
    back = tables.read_json_lines(spark, f"{path}/json", "n_nationkey long, n_name string, n_regionkey long").select(C("n_regionkey").alias("page")).distinct()
    pages = spark.read.text(f"{path}/pages").groupBy(C("page").cast("long").alias("page")).agg(F.count("*").alias("lines"), F.min("value").alias("first_line"))
    return pages.join(back, "page", "left_semi")


@query("""WITH r AS (SELECT p_partkey, upper(p_name) || ' (note, of sorts)' AS a, CASE WHEN p_size % 3 = 0 THEN 'uk ' || p_type ELSE 'seen live' END AS b FROM part)
SELECT p_partkey, upper(substr(lower(p_name), 1, 1)) || substr(lower(p_name), 2) || CASE WHEN p_size % 3 = 0 THEN '|UK ' || lower(p_type) ELSE '' END AS genres FROM part""")
def genre_titles(spark, sf_dir):
    """Genres of a source's text, cleaned and written for a heading, acronyms kept."""
    raw = F.concat(F.upper("p_name"), F.lit(" (note, of sorts);  "), F.when(C("p_size") % 3 == 0, F.concat(F.lit("UK "), "p_type")).otherwise("Seen  Live"), F.lit(", ??, lost �"))
    cleaned = upkeep.clean_genres(raw, ["seen live"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(cleaned, lambda g: upkeep.genre_title(g, ["uk", "edm"])), "|").alias("genres"))


_ROW = "SELECT '{name}' AS name, round(CAST(coalesce({value}, 0) AS DOUBLE), 6) AS value, CAST({bound} AS DOUBLE) AS bound, round(CAST(coalesce({value}, 0) AS DOUBLE), 6) {op} {bound} AS passed FROM {source}"
_SPECS = [
    ("heard_recount", "abs(count(*) FILTER (n > 0) - (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1)))", 0, "<=", "(SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1)"),
    ("heard_share_least", "count(*) FILTER (n > 0) / nullif(count(*), 0)", 0.05, ">=", "(SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1)"),
    ("heard_share_most", "count(*) FILTER (n > 0) / nullif(count(*), 0)", 0.40, "<=", "(SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1)"),
    ("accepted_unread", "count(*) FILTER (l_returnflag = 'A' AND NOT (l_linestatus = 'F' OR (l_linestatus = 'O' AND l_linenumber > 2))) / nullif(count(*), 0)", 0.01, "<=", "lineitem"),
    ("connections_hours", "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts) FILTER (event_type = 'view'))) / 3600000000.0", 36, "<=", "events"),
    ("threads_behind_hours", "(epoch_us(max(ts) FILTER (event_type = 'click')) - epoch_us(max(ts) FILTER (event_type = 'view'))) / 3600000000.0", 0, "<=", "events"),
    ("scattered_runs", "count(*) FILTER (n > 1) / nullif(count(*), 0)", 0.02, "<=", "(SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey)"),
]


@query(" UNION ALL ".join(_ROW.format(name=n, value=v, bound=b, op=o, source=s) for n, v, b, o, s in _SPECS))
def dq_heard_and_fresh(spark, sf_dir):
    """Heard counts recounted from the sessions themselves, their share within bounds, claims accepted unread, freshness, scattered runs."""
    of = lambda name: table(spark, sf_dir, name)
    customer, orders, lines, events = of("customer"), of("orders"), of("lineitem"), of("events")
    finished = orders.where("o_orderstatus = 'F'")
    heard = customer.join(finished, C("o_custkey") == C("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    recount = finished.join(customer, C("o_custkey") == C("c_custkey"), "left_semi").select("o_custkey").distinct().agg(F.count("*").alias("again"))
    at = lambda kind: F.unix_micros(F.max(F.when(C("event_type") == kind, C("ts"))).cast("timestamp")) / 3600e6
    read = (C("l_linestatus") == "F") | ((C("l_linestatus") == "O") & (C("l_linenumber") > 2))
    runs = lines.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"))
    share = checks.share(C("n") > 0)
    return checks.suite(
        checks.at_most("heard_recount", heard.crossJoin(F.broadcast(recount)), F.abs(F.count_if(C("n") > 0) - F.max("again")), 0),  # one row
        checks.at_least("heard_share_least", heard, share, 0.05), checks.at_most("heard_share_most", heard, share, 0.40),
        checks.at_most("accepted_unread", lines, checks.share((C("l_returnflag") == "A") & ~read), 0.01),
        checks.at_most("connections_hours", events, F.unix_micros(F.lit("2024-01-31").cast("timestamp")) / 3600e6 - at("view"), 36),
        checks.at_most("threads_behind_hours", events, at("click") - at("view"), 0),
        checks.at_most("scattered_runs", runs, checks.share(C("n") > 1), 0.02),
    )


@query("""SELECT p_partkey, regexp_replace(p_name, '[/\\\\:;!?.,"()\\[\\]]+', ' ', 'g') AS plain, p_name AS base FROM part""")
def plain_titles(spark, sf_dir):
    """Titles without signs for a search, and album keys without the year that tells namesakes apart."""
    key = F.concat("p_name", F.when(C("p_size") % 2 == 0, F.concat(F.lit(" #"), 1900 + C("p_size"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", variants.plain_title(F.concat("p_name", F.lit("!?"))).alias("plain"), variants.base_album_key(key).alias("base"))


@query("""WITH c AS (SELECT l_orderkey, l_suppkey, CASE l_linenumber % 5 WHEN 0 THEN 'Mastering engineer' WHEN 1 THEN 'co-Producer' WHEN 2 THEN 'Lyrics by' WHEN 3 THEN 'guitar' ELSE 'Mixing' END AS role FROM lineitem)
SELECT l_suppkey, count(*) AS credits, round(sum(CASE WHEN role = 'Mastering engineer' THEN 0.3 WHEN role IN ('co-Producer', 'Lyrics by') THEN 1.0 ELSE 0.6 END), 4) AS weight FROM c GROUP BY 1""")
def role_weights(spark, sf_dir):
    """What a person's credits weigh together, by their roles."""
    roles = F.element_at(F.array(*map(F.lit, ("Mastering engineer", "co-Producer", "Lyrics by", "guitar", "Mixing"))), (C("l_linenumber") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("credits"), F.round(F.sum(texts.role_weight(roles)), 4).alias("weight"))
