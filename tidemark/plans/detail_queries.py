"""Readers, writers and smaller rules that queries did not reach yet, over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import claims, relational
from ..sources import tables
from ..sources.tables import table
from .registry import query

C = F.col


def _folder(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT r_name AS slug, n_name AS artist, 'album ' || n_nationkey AS album, CASE WHEN n_nationkey % 2 = 0 THEN 'mood=calm' ELSE '' END AS facets FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey < 3""")
def registry_lists(spark, sf_dir):
    """List files and the registry that names them, written from the tables and read as one table; other columns are facets."""
    root = _folder(spark, "lists")
    nation = table(spark, sf_dir, "nation")
    slugs = [(r.r_regionkey, r.r_name) for r in table(spark, sf_dir, "region").where("r_regionkey < 3").collect()]  # three lists
    for key, slug in slugs:
        rows = nation.where(C("n_regionkey") == key).select(F.concat(F.lit(" "), "n_name").alias("artist"), F.concat(F.lit("album "), "n_nationkey").alias("album"), F.when(C("n_nationkey") % 2 == 0, "calm").alias("mood"))
        tables.export_csv(rows, f"{root}/{slug}")
    tables.export_csv(spark.createDataFrame([(slug, slug) for _, slug in slugs], "slug string, file string"), f"{root}/registry")
    found = tables.read_registry(spark, f"{root}/registry", root, ["artist", "album"], ["year"])
    facets = F.array_join(F.transform(F.map_entries("facets"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("slug", "artist", "album", facets.alias("facets"))


@query("SELECT o_orderkey AS id, o_orderpriority AS predicate, CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS roles FROM orders")
def json_claims(spark, sf_dir):
    """Claims as JSON lines, written and read under a declared schema."""
    path = _folder(spark, "claims")
    rows = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("predicate"), F.when(C("o_orderkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("roles"), F.lit(1).alias("beyond"))
    tables.export_json(rows, path)
    return tables.read_json_lines(spark, path, "id long, predicate string, roles array<string>").select("id", "predicate", F.when(C("roles").isNotNull(), F.size("roles")).alias("roles"))


@query("""SELECT 'http://x.example/' || n_nationkey AS url, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS title, 'About ' || n_name AS first_line, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS lines FROM nation""")
def markdown_pages(spark, sf_dir):
    """Pages with front matter, written one file each and read whole."""
    path = _folder(spark, "pages")
    title = F.when(C("n_nationkey") % 3 > 0, F.concat(F.lit("title: "), "n_name", F.lit("\n"))).otherwise("title:\n")
    more = F.when(C("n_nationkey") % 2 == 0, "\nurl: not this one").otherwise("")
    text = F.concat(F.lit("---\nurl: http://x.example/"), "n_nationkey", F.lit("\n"), title, F.lit("---\nAbout "), "n_name", more)
    tables.export_pages(table(spark, sf_dir, "nation").withColumn("text", text), path, "n_nationkey", "text")
    lines = F.split(F.rtrim("body"), "\n")
    return tables.read_pages(spark, f"{path}/*").select("url", "title", F.trim(F.regexp_replace(lines[0], r"[\r\n]", "")).alias("first_line"), F.size(F.filter(F.split("body", "\n"), lambda x: x != "")).alias("lines"))


@query("""WITH t AS (SELECT p_partkey AS id, p_size AS a, p_brand AS old FROM part), n AS (SELECT p_partkey AS id, p_size + 1 AS a FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey + 1000000, 7 FROM part WHERE p_partkey % 50 = 0)
SELECT coalesce(t.id, n.id) AS id, coalesce(CAST(n.a AS VARCHAR), CAST(t.a AS VARCHAR)) AS size, t.old AS brand, CASE WHEN n.id IS NOT NULL THEN 'new' END AS mark FROM t FULL JOIN n ON n.id = t.id""")
def upsert_maps(spark, sf_dir):
    """Rows upserted by key, their maps merged entry by entry: new entries win, others stay."""
    key = C("p_partkey")
    part = table(spark, sf_dir, "part")
    old = part.select(key.alias("id"), F.create_map(F.lit("size"), C("p_size").cast("string"), F.lit("brand"), C("p_brand")).alias("facts"))
    new = part.where(key % 2 == 0).select(key.alias("id"), F.create_map(F.lit("size"), (C("p_size") + 1).cast("string"), F.lit("mark"), F.lit("new")).alias("facts")).union(part.where(key % 50 == 0).select(key + 1_000_000, F.create_map(F.lit("size"), F.lit("7"), F.lit("mark"), F.lit("new"))))
    return tables.upsert(old, new, ["id"], merge_maps=["facts"]).select("id", C("facts")["size"].alias("size"), C("facts")["brand"].alias("brand"), C("facts")["mark"].alias("mark"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def orphans_deleted(spark, sf_dir):
    """Lines whose order is gone go with it."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("l_orderkey"))
    return tables.delete_orphans(table(spark, sf_dir, "lineitem"), orders, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, printf('%g', l_quantity * power(10.0, l_linenumber * 3 - 8)) AS price, printf('%g', l_discount / 3) AS discount FROM lineitem""")
def numbers_shown(spark, sf_dir):
    """Fractions as they are shown: six digits, no zeros at the end, exponents for the very large and small."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tables.general_number(C("l_quantity") * F.pow(F.lit(10.0), C("l_linenumber") * 3 - 8)).alias("price"), tables.general_number(C("l_discount") / 3).alias("discount"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS line FROM nation""")
def json_rows(spark, sf_dir):
    return tables.as_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@query("""SELECT o_orderkey AS id, o_custkey AS item, o_orderdate AS started_at, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE 1 END AS tracks_played, 'full' AS session_type, 'manual' AS source FROM orders WHERE o_orderstatus = 'P' AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 120 < 60)""")
def manual_sessions(spark, sf_dir):
    """Plays marked by hand as sessions, without those taken back within an hour."""
    key = C("o_orderkey")
    played = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    plays = played.select(key.alias("id"), C("o_custkey").alias("item"), C("o_orderdate").alias("at"), F.when(key % 4 > 0, key % 4).alias("tracks"))
    undone = played.where(key % 3 == 0).select(key.alias("id"), (C("o_orderdate") + F.make_interval(mins=(key % 120).cast("int"))).alias("at"))
    return claims.manual_sessions(plays, undone)


_WORDS = "regexp_extract_all(text, '[A-Za-z]+')"


@query(rf"""WITH d AS (SELECT doc_id, text, coalesce({_WORDS}[3], '') AS a, coalesce({_WORDS}[40], '') AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, a, b FROM d WHERE a <> '' AND b <> '' AND regexp_matches(text, '(?s)(^|[^\pL\pN_])' || a || '([^\pL\pN_].{{0,148}}[^\pL\pN_]|[^\pL\pN_])' || b || '([^\pL\pN_]|$)|(^|[^\pL\pN_])' || b || '([^\pL\pN_].{{0,148}}[^\pL\pN_]|[^\pL\pN_])' || a || '([^\pL\pN_]|$)')""")
def own_mentions(spark, sf_dir):
    """Documents in which two words of their own stand within 150 characters of each other."""
    # Read as far as the word only.
    word = lambda n: F.regexp_extract("text", rf"^(?:[^A-Za-z]*+[A-Za-z]++){{{n}}}[^A-Za-z]*+([A-Za-z]++)", 1)
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", word(2).alias("a"), word(39).alias("b"))
    return docs.where(texts.own_words_near(C("text"), C("a"), C("b"), 150)).select("doc_id", "a", "b")


@query("""SELECT event_id, CAST(timezone(CASE user_id % 3 WHEN 0 THEN 'America/Chicago' WHEN 1 THEN 'Europe/Berlin' ELSE 'UTC' END, ts AT TIME ZONE 'UTC') AS TIMESTAMP) AS there FROM events""")
def venue_times(spark, sf_dir):
    """Times in the zone of each row's venue."""
    zone = F.when(C("user_id") % 3 == 0, "America/Chicago").when(C("user_id") % 3 == 1, "Europe/Berlin").otherwise("UTC")
    return table(spark, sf_dir, "events").select("event_id", F.convert_timezone(F.lit("UTC"), zone, C("ts").cast("timestamp_ntz")).alias("there"))


@query("""WITH w AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), k AS (SELECT DISTINCT date_trunc('week', ts) AS week FROM events)
SELECT week, n_regionkey, n_nationkey FROM k, w WHERE i = (weekofyear(week) + n_regionkey) % n""")
def week_rotation(spark, sf_dir):
    """One of each group every week, in turn by the number of the week."""
    nation = table(spark, sf_dir, "nation")
    sizes = nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    placed = nation.withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")) - 1).join(sizes, "n_regionkey")
    weeks = table(spark, sf_dir, "events").select(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).distinct()
    turns = weeks.withColumn("k", F.weekofyear("week"))
    return turns.crossJoin(F.broadcast(sizes.drop("n"))).join(placed, "n_regionkey").where(C("i") == (C("k") + C("n_regionkey")) % C("n")).select("week", "n_regionkey", "n_nationkey")  # five groups


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH k AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part), q AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN upper(p_name || ' ' || p_type) WHEN 2 THEN substr(p_name, 1, 3) || substr(p_name, 5) || ' ' || p_type ELSE 'zzz' END AS asked FROM part),
g AS (SELECT asked, {_GRAMS.format("asked")} AS ga FROM q), h AS (SELECT name, {_GRAMS.format("name")} AS gn FROM k),
t AS (SELECT asked, name, CASE WHEN asked = name THEN 1 WHEN lower(asked) = lower(name) THEN 2 WHEN len(list_intersect(ga, gn)) >= 0.6 * len(list_distinct(list_concat(ga, gn))) THEN 3 END AS tier FROM g, h)
SELECT asked, name, tier FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY asked)""")
def lookup_with_likeness(spark, sf_dir):
    """A batch of names looked up as they are, by their keys, and by likeness where neither finds any."""
    part = table(spark, sf_dir, "part")
    whole = F.concat_ws(" ", "p_name", "p_type")
    size = C("p_size") % 4
    known = tables.kept(part.select(whole.alias("name")).distinct(), "known")
    typo = F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)"), F.lit(" "), "p_type")
    asked = tables.kept(part.select(F.when(size == 0, whole).when(size == 1, F.upper(whole)).when(size == 2, typo).otherwise("zzz").alias("asked")).distinct(), "asked")
    exact = asked.join(known, C("asked") == C("name"))
    by_key = asked.join(known, F.lower("asked") == F.lower("name"))
    alike = texts.similar_names(asked.withColumnRenamed("asked", "name"), known, "name", 0.6).select("asked", C("found").alias("name"))
    return relational.tiered(["asked"], exact, by_key, alike)


@query("""WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || p_name, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS tracks, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS heard, count(DISTINCT l_partkey) AS titles, list_sort(list(DISTINCT s_nationkey)) AS places, bool_or(l_returnflag = 'A') AS credits, bool_or(l_discount > 0.09) AS lineage FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT o_orderkey, tracks, array_to_string(places, ',') AS places, array_to_string(list_filter([CASE WHEN NOT credits THEN 'people' END, CASE WHEN NOT lineage THEN 'lineage' END, CASE WHEN len(places) < 2 THEN 'places' END], lambda x: x IS NOT NULL), ',') AS gaps, CASE WHEN heard = titles THEN 'heard' WHEN heard > 0 THEN 'started' ELSE 'unheard' END AS state, heard || ' of ' || titles AS shown FROM orders JOIN l ON l_orderkey = o_orderkey""")
def album_briefs(spark, sf_dir):
    """All that is known of each album in one row: tracks in order, places, facets that lack, how far it was heard."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(C("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").join(table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    track = F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name")
    told = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(track)).alias("t"), F.size(F.collect_set(F.when(C("l_returnflag") == "R", C("l_partkey")))).alias("heard"), F.size(F.collect_set("l_partkey")).alias("titles"),  # two distinct counts would send every line three times
        F.array_sort(F.collect_set("s_nationkey")).alias("places"), F.bool_or(C("l_returnflag") == "A").alias("credits"), F.bool_or(C("l_discount") > 0.09).alias("lineage"),
    )
    gaps = F.array_compact(F.array(F.when(~C("credits"), F.lit("people")), F.when(~C("lineage"), F.lit("lineage")), F.when(F.size("places") < 2, F.lit("places"))))
    state = F.when(C("heard") == C("titles"), "heard").when(C("heard") > 0, "started").otherwise("unheard")
    brief = told.select("l_orderkey", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["l_linenumber"], x["p_name"])), "|").alias("tracks"), F.array_join("places", ",").alias("places"), F.array_join(gaps, ",").alias("gaps"), state.alias("state"), F.concat("heard", F.lit(" of "), "titles").alias("shown"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(brief, C("o_orderkey") == C("l_orderkey")).drop("l_orderkey")
