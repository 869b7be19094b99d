"""Catalogue queries: rollups, statuses, progress, scores, laterals, matches, choices, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import lists, matching, relational
from ..sources.tables import table, zipped_arrays
from .registry import query

NOW = "2024-02-01 00:00:00"


def _of(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _price(c: str = "l_extendedprice"):
    return F.round(F.sum(c), 2)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def filtered_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 250000").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-03-01'")
def optional_filters(spark, sf_dir):
    """A status is given, a priority is not; the window is half open."""
    df = relational.optional_filter(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority=None)
    return relational.half_open(df, "o_orderdate", "2000-01-01", "2000-03-01").select("o_orderkey", "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber, lag(l_returnflag) OVER w IS DISTINCT FROM l_returnflag AS changed FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""")
def distinct_from_previous(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (~F.lag("l_returnflag").over(w).eqNullSafe(F.col("l_returnflag"))).alias("changed"))


@query("""SELECT p_partkey, contains(lower(p_name), 'a') AS has_a, starts_with(p_name, split_part(p_name, ' ', 1) || ' ') AS longer, regexp_matches(p_name, '(?i)\\b(red|blue|green|part)\\b') AS word,
CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INTEGER) AS brand_number, strftime(TIMESTAMP '2024-01-01' + to_days(p_size), '%Y-%m') AS month FROM part""")
def text_predicates(spark, sf_dir):
    kind = F.split_part("p_name", F.lit(" "), F.lit(1))
    month = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.lower("p_name").contains("a").alias("has_a"), F.startswith("p_name", F.concat(kind, F.lit(" "))).alias("longer"), F.col("p_name").rlike(r"(?i)\b(red|blue|green|part)\b").alias("word"),
        F.nullif(F.regexp_extract("p_brand", r"(\d+)", 1), F.lit("")).cast("int").alias("brand_number"), month.alias("month"),
    )


@query("""WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_linestatus)) AS statuses FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_contains(flags, 'R') AS has_r, list_has_any(flags, ['A', 'N']) AS overlaps, list_has_all(['A', 'R'], flags) AS contained, CAST(len(flags) AS INTEGER) AS n, array_to_string(list_filter(flags, lambda x: x <> 'N'), ',') AS without_n FROM a""")
def array_predicates(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    lits = lambda *x: F.array(*map(F.lit, x))
    return flags.select(
        "l_orderkey", F.array_contains("flags", "R").alias("has_r"), F.arrays_overlap("flags", lits("A", "N")).alias("overlaps"), (F.size(F.array_except("flags", lits("A", "R"))) == 0).alias("contained"),
        F.size("flags").alias("n"), F.array_join(F.array_remove("flags", "N"), ",").alias("without_n"),
    )


@query("""SELECT o.o_custkey, count(DISTINCT o.o_orderkey) AS groups, count(*) AS listens, count(DISTINCT l.l_partkey) AS titles, round(sum(l.l_extendedprice), 2) AS total, min(l.l_shipdate) AS first_at, max(l.l_shipdate) AS last_at,
round(max(l.l_discount), 2) AS best, count(*) FILTER (l.l_returnflag = 'R') AS returned FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey""")
def group_rollup(spark, sf_dir):
    orders, lines = _of(spark, sf_dir, "orders", "lineitem")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_custkey").agg(
        F.countDistinct("o_orderkey").alias("groups"), F.count("*").alias("listens"), F.countDistinct("l_partkey").alias("titles"), _price().alias("total"), F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"),
        F.round(F.max("l_discount"), 2).alias("best"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"),
    )


@query("""SELECT c_custkey, coalesce(n, 0) AS listens, coalesce(s, 0) AS sessions FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS s FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey""")
def artist_rollup(spark, sf_dir):
    """Both counts are made before the joins, so that neither multiplies the other."""
    customers, orders, lines = _of(spark, sf_dir, "customer", "orders", "lineitem")
    listens = orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    sessions = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("s"))
    joined = customers.select("c_custkey").join(listens, "c_custkey", "left").join(sessions, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("listens"), F.coalesce("s", F.lit(0)).alias("sessions"))


_STATUS = """st AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, coalesce(fulls, 0) AS fulls, coalesce(parts, 0) AS parts, CASE WHEN coalesce(fulls, 0) > 0 THEN 'heard' WHEN coalesce(parts, 0) > 0 THEN 'started' ELSE 'unheard' END AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 25) AS fulls, count(*) FILTER (l_returnflag = 'A') AS parts FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey)"""


def _status(spark, sf_dir) -> DataFrame:
    orders, lines = _of(spark, sf_dir, "orders", "lineitem")
    full, part = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 25), F.col("l_returnflag") == "A"
    return lists.entry_status(orders, "o_orderkey", lines, "l_orderkey", full, part)


@query("WITH " + _STATUS + " SELECT o_orderkey, fulls, parts, status FROM st")
def entry_status(spark, sf_dir):
    return _status(spark, sf_dir).select("o_orderkey", "fulls", "parts", "status")


_PROGRESS = """ count(*) AS entries, count(*) FILTER (status = 'heard') AS heard, count(*) FILTER (status = 'started') AS started, count(*) FILTER (status = 'unheard') AS unheard,
floor((2000 * count(*) FILTER (status = 'heard') + count(*)) / (2 * count(*))) / 10 AS pct FROM st """


@query("WITH " + _STATUS + " SELECT o_orderpriority," + _PROGRESS + "GROUP BY 1")
def progress_by_list(spark, sf_dir):
    return lists.progress(_status(spark, sf_dir), ["o_orderpriority"])


@query("WITH " + _STATUS + " SELECT n_name," + _PROGRESS + "JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def progress_by_lane(spark, sf_dir):
    customers, nations = _of(spark, sf_dir, "customer", "nation")
    placed = customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return lists.progress(_status(spark, sf_dir).join(placed, "o_custkey"), ["n_name"])


@query("WITH " + _STATUS + " SELECT r_name," + _PROGRESS + "JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def progress_by_zone(spark, sf_dir):
    customers, nations, regions = _of(spark, sf_dir, "customer", "nation", "region")
    zones = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    placed = customers.join(zones, customers.c_nationkey == zones.n_nationkey).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    return lists.progress(_status(spark, sf_dir).join(placed, "o_custkey"), ["r_name"])


_SCORES = """ent AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderpriority WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 2.0 ELSE 1.0 END AS tier,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
sc AS (SELECT o_custkey, o_orderkey, round(tier * CASE WHEN size > 1 THEN 1 - 0.5 * (pos - 1) / (size - 1) ELSE 1.0 END * (1 + 0.5 * least(ln(1 + size) / ln(501), 1.0)), 3) AS score FROM ent WHERE o_custkey % 7 <> 0)"""


def _scored(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_custkey % 7 <> 0")
    w = Window.partitionBy("o_custkey")
    placed = orders.withColumn("pos", F.row_number().over(w.orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")))).withColumn("size", F.count("*").over(w))
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", 3.0).when(F.col("o_orderpriority") == "2-HIGH", 2.0).otherwise(1.0)
    score = F.round(tier * scores.position_factor(F.col("pos"), F.col("size")) * scores.affinity(F.col("size"), 0.5), 3)
    return placed.select("o_custkey", "o_orderkey", score.alias("score"))


@query("WITH " + _SCORES + " SELECT * FROM sc")
def candidate_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


@query("WITH " + _SCORES + " SELECT o_custkey, o_orderkey, score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS r FROM sc) WHERE r = 1 ORDER BY score DESC, o_orderkey LIMIT 50")
def new_slots_one_per_artist(spark, sf_dir):
    best = relational.first_per(_scored(spark, sf_dir), ["o_custkey"], F.desc("score"), F.asc("o_orderkey"))
    return best.orderBy(F.desc("score"), F.asc("o_orderkey")).limit(50)


@query("WITH " + _SCORES + """, p AS (SELECT o_orderkey, row_number() OVER (ORDER BY score DESC, o_orderkey) AS rank, 'all' AS profile FROM sc QUALIFY rank <= 300
  UNION ALL SELECT o_orderkey, row_number() OVER (ORDER BY score DESC, o_orderkey), 'odd' FROM sc WHERE o_orderkey % 2 = 1 QUALIFY row_number() OVER (ORDER BY score DESC, o_orderkey) <= 300)
SELECT o_orderkey, CAST(min(rank) AS INTEGER) AS best_rank, count(*) AS profiles FROM p GROUP BY 1""")
def near_queue_best_rank(spark, sf_dir):
    """The best rank of each album over profiles, the top 300 of each. Each profile's top rows are cut before they are numbered."""
    found = _scored(spark, sf_dir)
    top = lambda df: relational.numbered_top(df, 300, F.desc("score"), F.asc("o_orderkey"))
    both = top(found).unionByName(top(found.where("o_orderkey % 2 = 1")))
    return both.groupBy("o_orderkey").agg(F.min("rank").alias("best_rank"), F.count("*").alias("profiles"))


@query("""SELECT c_custkey, round(ln(n + 1) * least(t / 5.0, 3.0) * pow(0.5, y / 2), 4) AS score FROM (SELECT o_custkey AS c_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS t,
(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(o_orderdate))) / (86400000000.0 * 365.25) AS y FROM orders GROUP BY 1)""")
def match_score(spark, sf_dir):
    years = scores.days_between(F.lit(NOW), F.max("o_orderdate")) / 365.25
    score = F.round(scores.match_score(F.count("*"), F.countDistinct("o_orderpriority"), years), 4)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(score.alias("score"))


@query("""SELECT o_orderkey, l_partkey, l_extendedprice FROM orders LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS r FROM lineitem) WHERE r = 1) ON l_orderkey = o_orderkey""")
def best_performer_lateral(spark, sf_dir):
    """The dearest line of every order; min_by keeps one row per key before the shuffle, where a window would sort all."""
    orders, lines = _of(spark, sf_dir, "orders", "lineitem")
    best = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by(F.struct("l_partkey", "l_extendedprice"), F.struct(-F.col("l_extendedprice"), "l_partkey", "l_linenumber")).alias("b"))
    return orders.select("o_orderkey").join(best, "o_orderkey", "left").select("o_orderkey", "b.l_partkey", "b.l_extendedprice")


@query("""SELECT o_orderkey, nxt AS next_at, open AS n_open FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) FILTER (l_shipdate > TIMESTAMP '1998-06-01') AS nxt, count(*) FILTER (l_shipdate <= TIMESTAMP '1998-06-01') AS open FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def next_window_lateral(spark, sf_dir):
    orders, lines = _of(spark, sf_dir, "orders", "lineitem")
    at = F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp_ntz")
    found = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.when(at, F.col("l_shipdate"))).alias("next_at"), F.count(F.when(~at, 1)).alias("n_open"))
    return orders.select("o_orderkey").join(found, "o_orderkey", "left")


@query("""SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND date_trunc('month', b.o_orderdate) = date_trunc('month', a.o_orderdate) AND b.o_orderstatus <> 'P'
AND ((b.o_orderpriority = '1-URGENT') > (a.o_orderpriority = '1-URGENT') OR (b.o_orderpriority = '1-URGENT') = (a.o_orderpriority = '1-URGENT') AND b.o_orderkey < a.o_orderkey))""")
def one_per_night(spark, sf_dir):
    """A row stays unless a live twin is better; a cancelled row suppresses nothing yet may itself stay."""
    df = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    rank = F.struct((F.col("o_orderpriority") == "1-URGENT").alias("first"), (-F.col("o_orderkey")).alias("then"))
    best = F.max(F.when(F.col("o_orderstatus") != "P", rank)).over(Window.partitionBy("o_custkey", "month"))
    return df.withColumn("best", best).where(F.col("best").isNull() | (rank >= F.col("best"))).select("o_orderkey")


_PLACES = "SELECT {k} AS id, 40 + ({k} * 7919 % 10007) / 100000.0 AS lat, -80 + ({k} * 104729 % 10009) / 100000.0 AS lon FROM {t}"


@query("WITH a AS (" + _PLACES.format(k="s_suppkey", t="supplier") + "), b AS (" + _PLACES.format(k="c_custkey", t="customer") + """),
d AS (SELECT a.id AS s_suppkey, b.id AS c_custkey, 6371000.0 * sqrt(pow(radians(b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(radians(b.lat - a.lat), 2)) AS m FROM a, b)
SELECT s_suppkey, c_custkey, round(m, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY m, c_custkey) AS r FROM d WHERE m <= 150) WHERE r = 1""")
def nearby_pairs(spark, sf_dir):
    suppliers, customers = _of(spark, sf_dir, "supplier", "customer")

    def places(df, key):
        k = F.col(key)
        return df.select(k, (40 + k * 7919 % 10007 / 100000.0).alias("lat"), (-80 + k * 104729 % 10009 / 100000.0).alias("lon"))

    found = relational.nearest_within(places(suppliers, "s_suppkey"), places(customers, "c_custkey"), 150, "s_suppkey", "c_custkey")
    return found.withColumn("metres", F.round("metres", 3))


@query("""SELECT l_orderkey, count(DISTINCT a_line) AS matched FROM (SELECT a.l_orderkey, a.l_linenumber AS a_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND (a.l_partkey = b.l_partkey OR a.l_suppkey = b.l_suppkey)) GROUP BY 1""")
def track_match_disjunctive(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return matching.either_equal(lines, lines, "l_orderkey", "l_linenumber", [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")])


@query("""SELECT o_orderkey, n, unmatched FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)) AS unmatched FROM lineitem GROUP BY 1) WHERE unmatched >= 3 AND 10 * unmatched >= 4 * n""")
def unmatched_titles(spark, sf_dir):
    """Groups with at least three titles, and 40 % of all, that their list lacks."""
    lines, parts = _of(spark, sf_dir, "lineitem", "part")
    known = parts.where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("known"))
    counted = lines.join(known, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("known").isNull(), 1)).alias("unmatched"))
    return counted.where("unmatched >= 3 and 10 * unmatched >= 4 * n")


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS picked FROM orders GROUP BY 1""")
def home_pick_if_unique(spark, sf_dir):
    return relational.pick_if_unique(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority")


_HOMES = """cand AS (SELECT DISTINCT l_partkey, l_orderkey, how, yr FROM (SELECT l_partkey, l_orderkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS how, CASE WHEN l_linestatus = 'O' THEN NULL ELSE year(l_shipdate) END AS yr FROM lineitem))"""


@query("WITH " + _HOMES + """, r AS (SELECT *, count(*) OVER (PARTITION BY l_partkey, how, yr) AS ties, row_number() OVER (PARTITION BY l_partkey ORDER BY how, yr NULLS LAST, l_orderkey) AS r FROM cand)
SELECT l_partkey, l_orderkey FROM r WHERE r = 1 AND ties = 1""")
def compilation_home(spark, sf_dir):
    """The earliest home by the better way; a tie means none. Null years tie with each other."""
    year = F.when(F.col("l_linestatus") != "O", F.year("l_shipdate"))
    cand = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("how"), year.alias("yr")).distinct()
    tied = cand.withColumn("ties", F.count("*").over(Window.partitionBy("l_partkey", "how", "yr")))
    return relational.first_per(tied, ["l_partkey"], F.asc("how"), F.asc_nulls_last("yr"), F.asc("l_orderkey")).where("ties = 1").select("l_partkey", "l_orderkey")


@query("""WITH a AS (SELECT *, max(p_size > 25) OVER (PARTITION BY p_brand) AS any1 FROM part), b AS (SELECT * FROM a WHERE p_size > 25 OR NOT any1),
c AS (SELECT *, max(starts_with(p_type, 'STANDARD')) OVER (PARTITION BY p_brand) AS any2 FROM b) SELECT p_partkey FROM c WHERE starts_with(p_type, 'STANDARD') OR NOT any2""")
def fallback_narrowing(spark, sf_dir):
    return relational.narrow(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size") > 25, F.startswith("p_type", F.lit("STANDARD"))).select("p_partkey")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
a AS (SELECT *, max(n > 0) OVER w AS k FROM r WINDOW w AS (PARTITION BY o_custkey)), b AS (SELECT * EXCLUDE k FROM a WHERE n > 0 OR NOT k),
c AS (SELECT *, max(o_orderstatus = 'F') OVER w AS k FROM b WINDOW w AS (PARTITION BY o_custkey)), d AS (SELECT * EXCLUDE k FROM c WHERE o_orderstatus = 'F' OR NOT k),
e AS (SELECT *, datediff('month', min(o_orderdate) OVER w, o_orderdate) <= 12 AS keep FROM d WINDOW w AS (PARTITION BY o_custkey)), f AS (SELECT * EXCLUDE keep FROM e WHERE keep),
g AS (SELECT o_custkey, arg_max(n, (c * 1000000 + n)) AS mode FROM (SELECT o_custkey, n, count(*) AS c FROM f GROUP BY ALL) GROUP BY 1),
h AS (SELECT f.*, 10 * n >= 6 * mode AS keep FROM f JOIN g USING (o_custkey))
SELECT o_custkey, o_orderkey, n AS tracks FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n, o_orderdate, o_orderkey) AS r FROM h WHERE keep) WHERE r = 1""")
def canonical_choice(spark, sf_dir):
    """With tracks, official, within twelve months of the first, 60 % of the usual track count; then fewest tracks, earliest, least id."""
    orders, lines = _of(spark, sf_dir, "orders", "lineitem")
    tracks = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    releases = orders.join(tracks, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return lists.choose_release(releases, "o_custkey", "o_orderkey", "n", F.col("o_orderstatus") == "F", "o_orderdate")


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, sf_dir):
    suppliers, customers = _of(spark, sf_dir, "supplier", "customer")
    return suppliers.select(F.col("s_nationkey").alias("k")).union(customers.select("c_nationkey")).distinct()


@query("""SELECT * FROM (SELECT s_name AS name, 1 AS priority FROM supplier WHERE s_acctbal > 8000 UNION ALL SELECT name, 2 FROM (SELECT c_name AS name FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 20))""")
def union_all_ranked(spark, sf_dir):
    """All that are active and the k stalest."""
    suppliers, customers = _of(spark, sf_dir, "supplier", "customer")
    stale = customers.where("c_acctbal < 0").orderBy("c_acctbal", "c_custkey").limit(20).select(F.col("c_name").alias("name"), F.lit(2).alias("priority"))
    return suppliers.where("s_acctbal > 8000").select(F.col("s_name").alias("name"), F.lit(1).alias("priority")).unionByName(stale)


@query("""SELECT c_custkey, count(DISTINCT s_suppkey) AS near FROM (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_nationkey IN (c_nationkey, c_custkey % 25)) GROUP BY 1""")
def either_key_join(spark, sf_dir):
    suppliers, customers = _of(spark, sf_dir, "supplier", "customer")
    return relational.either_key_count(customers, suppliers, "c_custkey", [F.col("c_nationkey"), (F.col("c_custkey") % 25).cast("int")], "s_nationkey", "s_suppkey", "near")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    orders, customers = _of(spark, sf_dir, "orders", "customer")
    return customers.join(orders.where("o_totalprice > 300000"), customers.c_custkey == orders.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf_dir):
    """Customers without an urgent finished order."""
    orders, customers = _of(spark, sf_dir, "orders", "customer")
    urgent = orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return customers.join(urgent, customers.c_custkey == urgent.o_custkey, "left_anti").select("c_custkey")


@query("""SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS flags, bool_and(l_quantity > 5) AS all_many FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT l_suppkey) AND count(*) > 2""")
def ordered_string_agg(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    flags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda s: s["l_returnflag"]), ",")
    grouped = lines.groupBy("l_orderkey").agg(flags.alias("flags"), F.bool_and(F.col("l_quantity") > 5).alias("all_many"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("d"))
    return grouped.where("n > d and n > 2").drop("n", "d")


@query("SELECT o_orderpriority, floor((2000 * count(*) FILTER (o_orderstatus = 'F') + count(*)) / (2 * count(*))) / 1000 AS share FROM orders GROUP BY 1")
def shares(spark, sf_dir):
    from ..operators.sessions import share_to_milli

    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(share_to_milli(F.count(F.when(F.col("o_orderstatus") == "F", 1)), F.count("*")).alias("share"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")
def page_of_results(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("""SELECT l_suppkey, l_partkey, rank FROM (SELECT l_suppkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY total DESC, l_partkey) AS INTEGER) AS rank
FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)) WHERE rank <= 3""")
def top_parts_per_supplier(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("total"))
    return relational.top_per(totals, ["l_suppkey"], 3, F.desc("total"), F.asc("l_partkey")).select("l_suppkey", "l_partkey", "rank")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def most_common(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("""WITH w AS (SELECT o_custkey, count(DISTINCT date_trunc('week', o_orderdate)) AS weeks, count(DISTINCT date_trunc('week', o_orderdate)) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS earlier,
count(DISTINCT date_trunc('week', o_orderdate)) FILTER (o_orderpriority = '1-URGENT') AS top FROM orders GROUP BY 1), s AS (SELECT o_custkey, round(weeks - earlier + 0.3 * earlier + 2.0 * top, 2) AS score FROM w)
SELECT o_custkey, score, CAST(row_number() OVER (ORDER BY score DESC, o_custkey) AS INTEGER) AS rank FROM s QUALIFY rank <= 100""")
def weighted_list_rank(spark, sf_dir):
    """Weeks listed since a year, plus a share of those before, plus weeks at the top; the best 100."""
    week, when = F.date_trunc("week", F.col("o_orderdate").cast("timestamp")), F.when
    early = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct(week).alias("weeks"), F.countDistinct(when(early, week)).alias("earlier"), F.countDistinct(when(F.col("o_orderpriority") == "1-URGENT", week)).alias("top"))
    score = F.round(F.col("weeks") - F.col("earlier") + 0.3 * F.col("earlier") + 2.0 * F.col("top"), 2)
    return relational.numbered_top(counted.select("o_custkey", score.alias("score")), 100, F.desc("score"), F.asc("o_custkey"))


@query("SELECT * FROM (VALUES (1, 'a', 0.5), (2, 'b', 0.25), (3, 'c', 0.125)) t(id, name, share) JOIN (SELECT n_nationkey AS id, n_name FROM nation) USING (id)")
def array_parameters(spark, sf_dir):
    """Parallel arrays given by a caller, as rows."""
    given = zipped_arrays(spark, id=[1, 2, 3], name=["a", "b", "c"], share=[0.5, 0.25, 0.125]).withColumn("id", F.col("id").cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name").join(F.broadcast(given), "id")  # three rows


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 4), p AS (SELECT l_orderkey, l_linenumber AS play, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3),
m AS (SELECT p.l_orderkey, p.play, 1 AS tier, t.l_linenumber AS pos FROM p JOIN t ON t.l_orderkey = p.l_orderkey AND t.l_partkey = p.l_partkey
  UNION ALL SELECT p.l_orderkey, p.play, 2, t.l_linenumber FROM p JOIN t ON t.l_orderkey = p.l_orderkey AND t.l_suppkey = p.l_suppkey)
SELECT l_orderkey, play, CAST(min(CASE WHEN tier = best THEN pos END) AS INTEGER) AS position FROM (SELECT *, min(tier) OVER (PARTITION BY l_orderkey, play) AS best FROM m) GROUP BY ALL""")
def track_matcher(spark, sf_dir):
    """A play's position on the list: by recording, else by title; the first tier with any match decides, then the least position."""
    lines = table(spark, sf_dir, "lineitem")
    plays = lines.where("l_linenumber >= 3").select("l_orderkey", F.col("l_linenumber").alias("play"), "l_partkey", "l_suppkey")
    tracks = lines.where("l_linenumber <= 4").select("l_orderkey", F.col("l_linenumber").alias("position"), "l_partkey", "l_suppkey")
    return matching.tiered_positions(plays, tracks, ["l_orderkey"], ["play"], [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")], "position")


@query("""WITH k AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal <= 7000), h AS (SELECT s_nationkey, min(s_suppkey) AS home FROM supplier WHERE s_acctbal > 7000 GROUP BY 1 HAVING count(*) = 1)
SELECT s_suppkey, home FROM k JOIN h USING (s_nationkey)""")
def fold_into_unique_home(spark, sf_dir):
    """Groups without a list go to the only group of their key that has one."""
    suppliers = table(spark, sf_dir, "supplier")
    return matching.fold_untracked(suppliers.where("s_acctbal <= 7000"), suppliers.where("s_acctbal > 7000"), "s_nationkey", "s_suppkey")


@query("""WITH u AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'), t AS (SELECT l_orderkey, l_partkey FROM lineitem),
c AS (SELECT a.o_orderkey AS unmapped, b.o_orderkey AS home, count(DISTINCT x.l_partkey) AS shared FROM u a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderstatus <> 'O' JOIN t x ON x.l_orderkey = a.o_orderkey JOIN t y ON y.l_orderkey = b.o_orderkey AND x.l_partkey = y.l_partkey GROUP BY ALL)
SELECT unmapped, home, shared FROM (SELECT *, rank() OVER (PARTITION BY unmapped ORDER BY shared DESC) AS r, count(*) OVER (PARTITION BY unmapped, shared) AS ties FROM c) WHERE r = 1 AND ties = 1""")
def overlap_home(spark, sf_dir):
    """The one group of the same owner that shares most titles; a tie means none."""
    orders, lines = _of(spark, sf_dir, "orders", "lineitem")
    titles = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct().join(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    return matching.pick_by_overlap(titles.where("o_orderstatus = 'O'"), titles.where("o_orderstatus <> 'O'"), ["o_custkey"], "l_partkey", "o_orderkey")


@query("""WITH g AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS genre FROM part), a AS (SELECT genre, count(DISTINCT p_partkey) AS albums FROM g GROUP BY 1)
SELECT p_partkey, genre, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY cited DESC, albums DESC, genre) AS INTEGER) AS rank FROM (SELECT p_partkey, genre, count(*) AS cited FROM g GROUP BY ALL) JOIN a USING (genre)""")
def genre_ranked(spark, sf_dir):
    genres = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("genre"))
    return lists.ranked_tags(genres, "p_partkey", "genre")


@query("""WITH g AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS genre FROM part) SELECT a.genre AS tag_a, b.genre AS tag_b, count(*) AS n FROM g a JOIN g b ON a.p_partkey = b.p_partkey AND a.genre < b.genre GROUP BY ALL""")
def genre_related(spark, sf_dir):
    from ..operators.graph import related_pairs

    return related_pairs(table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("genre")), "p_partkey", "genre")


@query("""WITH recent AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS g FROM part WHERE p_partkey % 97 = 0 AND p_size < 12)
SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM recent WHERE list_contains(string_split(p_type, ' '), g))""")
def no_recent_overlap(spark, sf_dir):
    """Albums that share no genre with recent ones."""
    parts = table(spark, sf_dir, "part")
    genres = parts.select("p_partkey", F.explode(F.split("p_type", " ")).alias("genre"))
    recent = genres.join(parts.where("p_partkey % 97 = 0 and p_size < 12").select("p_partkey"), "p_partkey", "left_semi").select("genre").distinct()
    return parts.select("p_partkey").join(genres.join(recent, "genre", "left_semi"), "p_partkey", "left_anti")


@query("""WITH d AS (SELECT lower(p_brand) AS key, p_size AS yr, p_partkey FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY key, yr ORDER BY p_partkey) AS r FROM d),
f AS (SELECT key, yr, p_partkey, yr - lag(yr) OVER (PARTITION BY key ORDER BY yr) AS gap FROM k WHERE r = 1)
SELECT key, yr, p_partkey, CASE WHEN gap > 1 THEN key || ' #' || yr ELSE key END AS label FROM f WHERE gap IS NULL OR gap > 1""")
def list_entries_by_year(spark, sf_dir):
    """Rows of one key count as one unless their years lie more than one apart; those get the year in their label."""
    parts = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("key"), F.col("p_size").alias("yr"), "p_partkey")
    once = relational.first_per(parts, ["key", "yr"], F.asc("p_partkey"))
    gap = F.col("yr") - F.lag("yr").over(Window.partitionBy("key").orderBy("yr"))
    found = once.withColumn("gap", gap).where("gap is null or gap > 1")
    return found.select("key", "yr", "p_partkey", F.when(F.col("gap") > 1, F.concat_ws(" #", "key", F.col("yr").cast("string"))).otherwise(F.col("key")).alias("label"))


@query("""WITH b AS (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS seq, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS spent FROM orders)
SELECT o_orderkey, o_custkey, seq, spent FROM b WHERE spent <= 500000""")
def running_cap(spark, sf_dir):
    """Plan order, with a cap on the running cost."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    spent = F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("seq"), spent.alias("spent")).where("spent <= 500000")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'hide' WHEN 'O' THEN 'pin' ELSE 'undo' END AS act, o_orderdate FROM orders)
SELECT o_custkey, act AS last_action, o_orderkey AS action_id, act = 'pin' AS pinned, act = 'hide' AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM s) WHERE r = 1""")
def queue_state(spark, sf_dir):
    """An event log of actions folded to its latest state, with one partial row per key and task before the shuffle."""
    act = F.when(F.col("o_orderstatus") == "F", "hide").when(F.col("o_orderstatus") == "O", "pin").otherwise("undo")
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", act.alias("act"))).alias("l"))
    return last.select("o_custkey", F.col("l.act").alias("last_action"), F.col("l.o_orderkey").alias("action_id"), (F.col("l.act") == "pin").alias("pinned"), (F.col("l.act") == "hide").alias("hidden"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'failed' WHEN o_orderpriority = '1-URGENT' THEN 'running' ELSE 'requested' END AS state FROM orders""")
def lease_states(spark, sf_dir):
    """A lease that has run out becomes failed; finished work stays ready."""
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "failed").when(F.col("o_orderpriority") == "1-URGENT", "running").otherwise("requested")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))


@query("""WITH old AS (SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER) AS missed FROM customer WHERE c_custkey % 5 <> 0), seen AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, CAST(CASE WHEN o_custkey IS NOT NULL THEN 0 ELSE missed + 1 END AS INTEGER) AS missed, o_custkey IS NULL AND missed + 1 >= 3 AS cancelled FROM old FULL JOIN seen ON c_custkey = o_custkey""")
def missed_runs(spark, sf_dir):
    """The last snapshot merged with a new crawl: rows not seen count up and are cancelled at three."""
    customers, orders = _of(spark, sf_dir, "customer", "orders")
    old = customers.where("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_custkey") % 4).cast("int").alias("missed"))
    seen = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return lists.count_missed(old, seen, "c_custkey", "missed", 3)


@query("""WITH a AS (SELECT c_custkey AS id, lower(c_mktsegment) AS tag FROM customer), active AS (SELECT * FROM (VALUES ('building'), ('machinery'), ('unused')) t(tag))
SELECT tag, count(id) AS n FROM active LEFT JOIN a USING (tag) GROUP BY tag""")
def tag_counts(spark, sf_dir):
    given = spark.createDataFrame([("building",), ("machinery",), ("unused",)], "tag string")
    tagged = table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("tag")).agg(F.count("*").alias("n"))
    return given.join(tagged, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))
