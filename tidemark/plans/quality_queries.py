"""The data-quality suite over all tables: counts, duplicates, coverage, overlaps, freshness, secrets, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, sessions
from ..sources.tables import table
from .registry import query

_ROW = "SELECT '{name}' AS name, round(CAST(coalesce({value}, 0) AS DOUBLE), 6) AS value, CAST({bound} AS DOUBLE) AS bound, round(CAST(coalesce({value}, 0) AS DOUBLE), 6) {op} {bound} AS passed FROM {source}"
_ORDERLESS = "(SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey)"
_FLIPS = "(SELECT epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 AND lag(event_type) OVER w <> event_type AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_SPECS = [
    ("listen_gap", "abs(1 - count(*) FILTER (event_id % 200 <> 0) / nullif(count(*), 0))", 0.005, "<=", "events"),
    ("null_owner", "count(*) FILTER (user_id IS NULL)", 0, "<=", "events"),
    ("duplicate_keys", "count(*)", 0, "<=", "(SELECT user_id, ts, event_type FROM events GROUP BY ALL HAVING count(*) > 1)"),
    ("without_orders", "count(*) FILTER (o_orderkey IS NULL) / nullif(count(*), 0)", 0.4, "<=", _ORDERLESS),
    ("labelled", "count(quality) / nullif(count(*), 0)", 0.1, ">=", "(SELECT quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"),
    ("flips", "count(*) FILTER (f) / nullif(count(*), 0)", 0.5, "<=", _FLIPS),
    ("quantity_overshoot", "count(*) FILTER (l_quantity > 50) / nullif(count(*), 0)", 0.02, "<=", "lineitem"),
    ("fresh_days", "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 86400000000.0", 8, "<=", "events"),
    ("orphan_lines", "count(*)", 0, "<=", "(SELECT 1 FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey))"),
    ("empty_texts", "count(*) FILTER (text IS NULL OR text = '') / nullif(count(*), 0)", 0.05, "<=", "documents"),
    ("key_like_texts", "count(*) FILTER (regexp_matches(text, 'AKIA[A-Z0-9]{14}')) / nullif(count(*), 0)", 0.05, "<=", "documents"),
    ("text_size_mb", "sum(strlen(text)) / 1048576.0", 2048, "<=", "documents"),
    ("type_fit", "count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R'))", 0, "<=", "lineitem"),
    ("distinct_owners", "abs(count(*) - (SELECT count(DISTINCT user_id) FROM events))", 0, "<=", "(SELECT user_id FROM events GROUP BY user_id)"),
]


@query(" UNION ALL ".join(_ROW.format(name=n, value=v, bound=b, op=o, source=s) for n, v, b, o, s in _SPECS))
def dq_suite(spark, sf_dir):
    of = lambda name: table(spark, sf_dir, name)
    events, documents, lines = of("events"), of("documents"), of("lineitem")
    owned = of("customer").join(of("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")
    flips = sessions.flips(events, ["user_id"], "ts", "event_id", "event_type", 1800)
    is_ = F.col
    return checks.suite(
        checks.at_most("listen_gap", events, F.abs(1 - checks.share(is_("event_id") % 200 != 0)), 0.005),
        checks.at_most("null_owner", events, F.count(F.when(is_("user_id").isNull(), 1)), 0),
        checks.at_most("duplicate_keys", events.groupBy("user_id", "ts", "event_type").count().where("count > 1"), F.count("*"), 0),
        checks.at_most("without_orders", owned, checks.share(is_("o_orderkey").isNull()), 0.4),
        checks.at_least("labelled", documents.select("doc_id").join(of("labels"), "doc_id", "left"), checks.share(is_("quality").isNotNull()), 0.1),
        checks.at_most("flips", flips, F.sum("flips") / F.sum("n"), 0.5),
        checks.at_most("quantity_overshoot", lines, checks.share(is_("l_quantity") > 50), 0.02),
        checks.at_most("fresh_days", events, (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 86_400e6, 8),
        checks.at_most("orphan_lines", lines.join(of("orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), F.count("*"), 0),
        checks.at_most("empty_texts", documents, checks.share(is_("text").isNull() | (is_("text") == "")), 0.05),
        checks.at_most("key_like_texts", documents, checks.share(is_("text").rlike("AKIA[A-Z0-9]{14}")), 0.05),
        checks.at_most("text_size_mb", documents, F.sum(F.octet_length("text")) / 1048576, 2048),
        checks.at_most("type_fit", lines, F.count(F.when(~is_("l_returnflag").isin("A", "N", "R"), 1)), 0),
        checks.at_most("distinct_owners", sessions.gap_islands(events, ["user_id"], "ts", "event_id", 21_600).groupBy("user_id").agg(F.max("island")).crossJoin(F.broadcast(events.agg(F.countDistinct("user_id").alias("n")))), F.abs(F.count("*") - F.max("n")), 0),
    )


_MORE = [
    ("nightly_minutes", "sum(seconds) / 60.0", 15, "<=", "(SELECT arg_max(value, ts) AS seconds FROM events GROUP BY event_type)"),
    ("headliner_residue", "count(*) FILTER (regexp_matches(p_name, '(?i)\\\\b(tour|presents)\\\\b')) / nullif(count(*), 0)", 0.01, "<=", "part"),
    ("unsplit_support", "count(*) FILTER (contains(p_name, ' w/ '))", 0, "<=", "part"),
    ("headliners_resolved", "count(s_suppkey) / nullif(count(*), 0)", 0.95, ">=", "(SELECT s_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem) LEFT JOIN supplier ON s_suppkey = l_suppkey)"),
    ("lists_empty", "count(*)", 0, "<=", "(SELECT 1 FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey))"),
    ("positions_twice", "count(*) FILTER (n > 1) / nullif(count(*), 0)", 0.01, "<=", "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"),
    ("entries_matched", "count(o_orderkey) / nullif(count(*), 0)", 0.9, ">=", "(SELECT o_orderkey FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)"),
    ("evidence", "count(*) FILTER (l_discount IS NULL)", 0, "<=", "lineitem"),
    ("direction", "count(*) FILTER (l_shipdate < o_orderdate) / nullif(count(*), 0)", 0.6, "<=", "(SELECT l_shipdate, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"),
    ("settled", "count(*) FILTER (open > 0) / nullif(count(*), 0)", 0.9, "<=", "(SELECT count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY o_custkey)"),
    ("credits", "count(*) FILTER (n = 0) / nullif(count(*), 0)", 0.5, "<=", "(SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)"),
    ("disjoint_lines", "count(*) FILTER (words < 2)", 0, "<=", "(SELECT len(list_distinct(string_split(p_name, ' '))) AS words FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2))"),
]


@query(" UNION ALL ".join(_ROW.format(name=n, value=v.replace("\\\\", "\\"), bound=b, op=o, source=s) for n, v, b, o, s in _MORE))
def dq_shows_and_lists(spark, sf_dir):
    """Run times, listings, lists and claims: the second half of the suite."""
    of = lambda name: table(spark, sf_dir, name)
    is_, part, lines, orders = F.col, of("part"), of("lineitem"), of("orders")
    with_order = lines.join(orders, is_("o_orderkey") == is_("l_orderkey"), "left")
    latest = of("events").groupBy("event_type").agg(F.max_by("value", "ts").alias("seconds"))
    heads = lines.select("l_suppkey").distinct().join(of("supplier"), is_("s_suppkey") == is_("l_suppkey"), "left")
    credits = part.join(lines, is_("l_partkey") == is_("p_partkey"), "left").groupBy("p_partkey").agg(F.count("l_partkey").alias("n"))
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    return checks.suite(
        checks.at_most("nightly_minutes", latest, F.sum("seconds") / 60, 15),
        checks.at_most("headliner_residue", part, checks.share(is_("p_name").rlike(r"(?i)\b(tour|presents)\b")), 0.01),
        checks.at_most("unsplit_support", part, F.count(F.when(is_("p_name").contains(" w/ "), 1)), 0),
        checks.at_least("headliners_resolved", heads, checks.share(is_("s_suppkey").isNotNull()), 0.95),
        checks.at_most("lists_empty", of("region").join(of("nation"), is_("n_regionkey") == is_("r_regionkey"), "left_anti"), F.count("*"), 0),
        checks.at_most("positions_twice", lines.groupBy("l_orderkey", "l_linenumber").count(), checks.share(is_("count") > 1), 0.01),
        checks.at_least("entries_matched", with_order, checks.share(is_("o_orderkey").isNotNull()), 0.9),
        checks.at_most("evidence", lines, F.count(F.when(is_("l_discount").isNull(), 1)), 0),
        checks.at_most("direction", with_order.where("o_orderkey is not null"), checks.share(is_("l_shipdate") < is_("o_orderdate")), 0.6),
        checks.at_most("settled", orders.groupBy("o_custkey").agg(F.count_if(is_("o_orderstatus") == "O").alias("open")), checks.share(is_("open") > 0), 0.9),
        checks.at_most("credits", credits, checks.share(is_("n") == 0), 0.5),
        checks.at_most("disjoint_lines", part.where(first != second), F.count(F.when(F.size(F.array_distinct(F.split("p_name", " "))) < 2, 1)), 0),
    )
