"""Text queries: pages, cues, markers, mentions, extraction from HTML, trigram search, name keys, hashes, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, texts
from ..functions.titles import near_titles
from ..operators import relational
from ..sources.tables import as_tsv, read_only, table
from .registry import query


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_matches(url, '^https://') AS safe, contains(url, '?') AS has_query FROM pages""")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"), F.startswith("url", F.lit("https://")).alias("safe"), F.col("url").contains("?").alias("has_query"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<a\s[^>]*href=')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs, contains(html, 'application/ld+json') AS has_data FROM pages""")
def html_extract(spark, sf_dir):
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), count(r"<a\s[^>]*href=").alias("links"), count("<p[ >]").alias("paragraphs"), F.col("html").contains("application/ld+json").alias("has_data")
    )


@query(r"""SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY 1""")
def html_links(spark, sf_dir):
    hrefs = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return hrefs.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(translate(regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)', '\1', 'g'), '\[\d+\]', '', 'g'), '‘’“”«»', '''''' || repeat(chr(34), 4))), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM documents""")
def page_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.page_text(F.col("text")).alias("body"))


@query(r"""SELECT doc_id, count(*) AS cues, CAST(sum(length(p)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\n\s*\n'))) AS p FROM documents) WHERE length(p) >= 60 AND regexp_matches(p, '(?i)\b(?:license|password|key|token)\b') GROUP BY 1""")
def cue_paragraphs(spark, sf_dir):
    cues = table(spark, sf_dir, "documents").select("doc_id", F.explode(texts.cue_paragraphs(F.col("text"), ["license", "password", "key", "token"])).alias("p"))
    return cues.groupBy("doc_id").agg(F.count("*").alias("cues"), F.sum(F.length("p")).alias("chars"))


@query(r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\[([a-z]):(\w+)\]')) AS INTEGER) AS markers, text IS NULL OR trim(text) = '' AS is_empty FROM conversations""")
def marker_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.regexp_count("text", F.lit(r"\[([a-z]):(\w+)\]")), F.lit(0)).alias("markers"), (F.col("text").isNull() | (F.trim("text") == "")).alias("is_empty"))


@query("""WITH m AS (SELECT doc_id AS page, doc_id % 1500 AS marker FROM documents) SELECT page, marker, l.quality IS NOT NULL AS found, l.quality FROM m LEFT JOIN labels l ON l.doc_id = marker""")
def marker_resolution(spark, sf_dir):
    marks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), (F.col("doc_id") % 1500).alias("marker"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("marker"), "quality")
    return marks.join(known, "marker", "left").select("page", "marker", F.col("quality").isNotNull().alias("found"), "quality")


_PLAIN = r"trim(regexp_replace(lower({}), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT item_id, {_PLAIN.format("text")} AS quote FROM benchmark WHERE text IS NOT NULL AND trim(text) <> ''), d AS (SELECT doc_id, {_PLAIN.format("text")} AS body FROM documents WHERE text IS NOT NULL)
SELECT doc_id, item_id FROM d JOIN q ON contains(' ' || body || ' ', ' ' || quote || ' ')""")
def evidence_verbatim(spark, sf_dir):
    """Documents that hold a whole quote: places are found by a join on hashes of the quote's first words, then the whole quote is compared."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return texts.verbatim(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", quotes, "item_id", "quote").select("doc_id", "item_id")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, list_distinct(flatten(list_transform(string_split(name, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM n)
SELECT a.name AS asked, b.name AS found, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 4) AS score FROM g a JOIN g b ON a.name <> b.name WHERE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.3
QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY score DESC, b.name) <= 3""")
def trigram_top3(spark, sf_dir):
    """For every name the three others most like it by trigrams, of all names, from a similarity of 0.3 on."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    found = texts.similar_names(names, names, "name", 0.3).where("asked <> found").withColumn("score", F.round("score", 4))
    return relational.top_per(found, ["asked"], 3, F.desc("score"), F.asc("found")).drop("rank")


@query("""WITH q AS (SELECT c_custkey AS q, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN lower(c_name) ELSE 'no such name' END AS name FROM customer),
t AS (SELECT q, c_custkey, 1 AS tier FROM q JOIN customer ON c_name = name UNION ALL SELECT q, c_custkey, 2 FROM q JOIN customer ON lower(c_name) = lower(name))
SELECT q, c_custkey, tier FROM t QUALIFY tier = min(tier) OVER (PARTITION BY q)""")
def batch_lookup_tiers(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    third = F.col("c_custkey") % 3
    asked = customers.select(F.col("c_custkey").alias("q"), F.when(third == 0, F.col("c_name")).when(third == 1, F.lower("c_name")).otherwise(F.lit("no such name")).alias("name"))
    known = customers.select("c_custkey", F.col("c_name").alias("name"))
    exact = asked.join(known, "name").select("q", "c_custkey")
    by_key = asked.withColumn("name", F.lower("name")).join(known.withColumn("name", F.lower("name")), "name").select("q", "c_custkey")
    return relational.tiered(["q"], exact, by_key)


@query("""SELECT lang, count(*) AS albums, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def coverage_by_facet(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("albums"), F.count("quality").alias("labelled"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"))


@query(r"""SELECT p_partkey, sha1(concat_ws(chr(31), p_name, coalesce(p_brand, ''), CAST(p_size AS VARCHAR))) AS claim_key, CAST('0x' || substr(sha256(p_name), 1, 12) AS BIGINT) AS seed FROM part""")
def hash_keys(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", texts.joined_sha1(c("p_name"), c("p_brand"), c("p_size")).alias("claim_key"), texts.seed_of(c("p_name")).alias("seed"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS k, event_type AS kind FROM events""")
def json_merge(spark, sf_dir):
    """A map from JSON, with one entry changed and one added, read back."""
    given = F.from_json("props", "map<string,string>")
    merged = F.map_concat(F.map_filter(given, lambda k, _: k != "k"), F.create_map(F.lit("k"), (given["k"].cast("int") + 1).cast("string"), F.lit("kind"), F.col("event_type")))
    text = F.to_json(merged)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text, "$.k").cast("int").alias("k"), F.get_json_object(text, "$.kind").alias("kind"))


@query(r"""SELECT concat_ws(chr(9), CAST(n_nationkey AS VARCHAR), translate(n_name, chr(9) || chr(13) || chr(10), '   '), CAST(n_regionkey AS VARCHAR)) AS line FROM nation""")
def compact_rows(spark, sf_dir):
    return as_tsv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 10 ORDER BY n_name LIMIT 5")
def sql_gateway(spark, sf_dir):
    """One read-only statement over views of the tables, with a limit."""
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"gate_{name}")
    found, _ = read_only(spark, "SELECT n_name, r_name FROM gate_nation JOIN gate_region ON r_regionkey = n_regionkey WHERE n_nationkey < 10 ORDER BY n_name", 5)
    return found


@query(r"""SELECT page_id, regexp_replace(url || '&api_key=s' || page_id || '&x=1', '(?i)(key|token|secret|password)=[^&\s]+', '\1=***', 'g') AS url FROM pages""")
def key_redaction(spark, sf_dir):
    """Addresses of pages with a key in them, which is blotted out."""
    return table(spark, sf_dir, "pages").select("page_id", texts.redacted(F.concat("url", F.lit("&api_key=s"), "page_id", F.lit("&x=1"))).alias("url"))


@query("""SELECT name, count(*) AS n FROM (SELECT lower(p_brand) AS k, p_brand AS name FROM part) GROUP BY name QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY len(string_split(name, ' ')) DESC, n DESC, name) = 1""")
def best_spelling(spark, sf_dir):
    """Of the spellings of one key: most words, then most frequent, then first."""
    counted = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    best = counted.groupBy(F.lower("name").alias("k")).agg(F.min_by(F.struct("name", "n"), F.struct(-F.size(F.split("name", " ")), -F.col("n"), "name")).alias("b"))
    return best.select("b.name", "b.n")


@query()
def norm_keys(spark, sf_dir):
    """Keys of every distinct name; rows join back by name."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "customer").select("c_name")).distinct()
    return names.withColumn("k", keys.all_keys_udf("name")).select("name", "k.*")


@query()
def loose_keys(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.explode(keys.loose_title_keys_udf("name")).alias("loose_key"))


@query("""SELECT 'The ' || p_name || ' (Deluxe)' AS name, lower('The ' || p_name || ' (Deluxe)') AS stored, p_name || ' deluxe' AS computed, count(*) AS n FROM part GROUP BY p_name""")
def key_change_impact(spark, sf_dir):
    """Stored keys against recomputed ones, only where they differ, with their counts."""
    names = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", F.lit("The"), "p_name", F.lit("(Deluxe)")).alias("name")).agg(F.count("*").alias("n"))
    return names.select("name", F.lower("name").alias("stored"), keys.name_key_udf("name").alias("computed"), "n").where("stored <> computed")


@query()
def near_title_pairs(spark, sf_dir):
    """All names that are nearly equal; a join on rare bigrams brings together all that can be."""
    names = table(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("title"))
    return near_titles(names, names, "title")


@query(r"""SELECT doc_id, true AS near FROM (SELECT doc_id, trim(regexp_replace(lower(translate(regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)', '\1', 'g'), '\[\d+\]', '', 'g'), '‘’“”«»', '''''' || repeat(chr(34), 4))), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS body FROM documents) WHERE regexp_matches(body, '(?s)\blicense\b.{0,150}\breleased\b|\breleased\b.{0,150}\blicense\b')""")
def mention_proximity(spark, sf_dir):
    """Pages on which a word of a title stands within 150 characters of a name."""
    pages = table(spark, sf_dir, "documents").select("doc_id", texts.page_text(F.col("text")).alias("body"))
    return pages.select("doc_id", texts.mentioned_near(F.col("body"), "license", "released", 150).alias("near")).where("near")


@query("""SELECT event_id, event_type FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY md5('7' || ':' || event_id), event_id LIMIT 20)""")
def seeded_sample(spark, sf_dir):
    """A sample that a seed decides: the rows with the least keyed hashes; one pass, one small top-k."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return df.orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string"))), "event_id").limit(20)


@query("""SELECT o_orderkey, ln((CAST('0x' || substr(sha256('7:' || o_orderkey), 1, 12) AS BIGINT) + 1) / 281474976710657.0) / o_totalprice AS draw FROM orders ORDER BY draw DESC, o_orderkey LIMIT 20""")
def weighted_sample(spark, sf_dir):
    """Without replacement, by weight: the largest of log(u) / weight, with u from a keyed hash."""
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string")), 256), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48) + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.log(unit) / F.col("o_totalprice")).alias("draw")).orderBy(F.desc("draw"), "o_orderkey").limit(20)


@query("""WITH s AS (SELECT o_orderkey AS item, o_custkey AS artist, CASE WHEN o_orderstatus = 'P' THEN 'pin' WHEN o_orderpriority = '1-URGENT' THEN 'revisit' ELSE 'new' END AS pool, o_totalprice AS score FROM orders), o AS (SELECT *, CASE pool WHEN 'pin' THEN 0 WHEN 'revisit' THEN 1 ELSE 2 END AS k FROM s),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY artist ORDER BY k, score DESC, item) = 1), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, item) <= CASE k WHEN 2 THEN 10 ELSE 3 END)
SELECT item, artist, pool, score, CAST(row_number() OVER (ORDER BY k, score DESC, item) AS INTEGER) AS rank FROM c ORDER BY k, score DESC, item LIMIT 10""")
def queue_composed(spark, sf_dir):
    """A queue: pins, then revisits and new albums in turn, one per artist, by rank. Each pool is cut to the queue's length before pools are mixed."""
    from ..operators.queue import compose

    orders = table(spark, sf_dir, "orders")
    pool = F.when(F.col("o_orderstatus") == "P", "pin").when(F.col("o_orderpriority") == "1-URGENT", "revisit").otherwise("new")
    return compose(orders.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("artist"), pool.alias("pool"), F.col("o_totalprice").alias("score")), {"pin": 3, "revisit": 3, "new": 10}, 10)


@query()
def queues_built(spark, sf_dir):
    """A queue for every customer of a nation's orders: pins, revisits from two pools in turn, threads, breakers, wildcards, new ones, mixed by a seed."""
    from ..operators.queue import build_queues

    key = F.col("o_orderkey")
    kind = F.when(key % 97 == 0, "pin").when(F.col("o_orderpriority") == "1-URGENT", "revisit").when(F.col("o_orderpriority") == "2-HIGH", "thread").when(key % 13 == 0, "breaker").otherwise("new")
    lane = F.when(kind == "revisit", F.col("o_orderstatus")).when(kind == "thread", (key % 5).cast("string")).otherwise("")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    place = F.row_number().over(Window.partitionBy("owner", "kind", "lane").orderBy(F.desc("o_totalprice"), "item"))
    offers = orders.select(F.col("c_nationkey").alias("owner"), kind.alias("kind"), lane.alias("lane"), key.alias("item"), (F.col("o_custkey") % 300).alias("artist"), "o_totalprice").withColumn("place", place)
    return build_queues(offers, 20, revisit_share=0.25, threads=3, breakers=2, wildcards=2, wild_ranks=(30, 90), seed=7)


_ASKED = "SELECT DISTINCT unnest([substr(p_name, 1, 4), substr(p_type, 1, 2), substr(p_name, 3, 5), replace(p_name, 'e', 'a'), upper(p_type)]) AS asked FROM part"


@query(f"""WITH n AS (SELECT p_name || ' ' || p_type AS name, lower(p_name || ' ' || p_type) AS low, count(*) AS weight FROM part GROUP BY ALL), a AS (SELECT asked, lower(trim(asked)) AS q FROM ({_ASKED}) WHERE length(trim(asked)) >= 2),
gn AS (SELECT low, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM n),
ga AS (SELECT DISTINCT q, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM a),
t AS (SELECT asked, name, weight, CASE WHEN starts_with(n.low, q) THEN 1 WHEN contains(' ' || n.low, ' ' || q) THEN 2 WHEN length(q) >= 3 AND contains(n.low, q) THEN 3 WHEN len(list_intersect(gn.g, ga.g)) >= 0.3 * len(list_distinct(list_concat(gn.g, ga.g))) THEN 4 END AS tier FROM a JOIN ga USING (q) CROSS JOIN n JOIN gn ON gn.low = n.low)
SELECT asked, name, tier, CAST(row_number() OVER (PARTITION BY asked ORDER BY tier, weight DESC, name) AS INTEGER) AS rank FROM t WHERE tier IS NOT NULL QUALIFY rank <= 5""")
def names_suggested(spark, sf_dir):
    """Names for what was typed: by beginning, by a word's beginning, by what they hold, by likeness; then by weight."""
    from ..operators.search import suggest

    part = table(spark, sf_dir, "part")
    names = part.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("name")).agg(F.count("*").alias("weight"))
    typed = F.array(F.substring("p_name", 1, 4), F.substring("p_type", 1, 2), F.substring("p_name", 3, 5), F.replace("p_name", F.lit("e"), F.lit("a")), F.upper("p_type"))
    return suggest(part.select(F.explode(typed).alias("asked")).distinct(), names, 5)
