"""Slices, seeding, batches of claims, queue actions and names across sources, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims
from ..sources.tables import table
from .registry import query

C = F.col


@query("""WITH p AS (SELECT DISTINCT l_partkey AS entry FROM lineitem WHERE l_suppkey = 7),
e AS (SELECT p_partkey AS entry, CASE p_size % 4 WHEN 0 THEN 'Essential' WHEN 1 THEN 'Recommended' WHEN 2 THEN 'Deep cut' END AS priority, p_retailprice > 1200 AS start_here, p_size, p_partkey IN (SELECT entry FROM p) AS on_path FROM part)
SELECT entry, priority, on_path, CAST(CASE WHEN priority = 'Essential' THEN 0 WHEN start_here OR on_path THEN 1 WHEN priority = 'Deep cut' THEN 3 ELSE 2 END AS INTEGER) AS tier FROM e WHERE p_size IN (4, 9, 14) OR on_path""")
def slice_targets(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    priority = F.when(C("p_size") % 4 == 0, "Essential").when(C("p_size") % 4 == 1, "Recommended").when(C("p_size") % 4 == 2, "Deep cut")
    entries = part.select(C("p_partkey").alias("entry"), priority.alias("priority"), (C("p_retailprice") > 1200).alias("start_here"), "p_size")
    path = table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select(C("l_partkey").alias("entry"))
    tiers = {"Essential": 0, "Recommended": 2, "Deep cut": 3}
    return claims.slice_targets(entries, path, C("p_size").isin(4, 9, 14), tiers).select("entry", "priority", "on_path", "tier")


@query("""SELECT 'predicate' AS type, count(DISTINCT l_returnflag) AS entities FROM lineitem UNION ALL SELECT 'lane', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'list', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'album', count(DISTINCT l_partkey) FROM lineitem""")
def seed_counts(spark, sf_dir):
    """Entities of all kinds from their own sources, each once by its key, and how many there are."""
    sources = [("predicate", "lineitem", "l_returnflag"), ("lane", "part", "p_brand"), ("list", "orders", "o_orderpriority"), ("album", "lineitem", "l_partkey")]
    entities = None
    for kind, name, key in sources:
        found = table(spark, sf_dir, name).select(F.lit(kind).alias("type"), C(key).cast("string").alias("key")).where("key is not null").distinct()
        entities = found if entities is None else entities.union(found)
    return entities.groupBy("type").agg(F.count("*").alias("entities"))


@query("""WITH stored AS (SELECT l_partkey || '/' || l_suppkey AS key, 'o' || l_orderkey AS label, 'accepted' AS status FROM lineitem WHERE l_linenumber = 1),
n AS (SELECT *, format('B1-{}-L{:03d}', album, row_number() OVER (PARTITION BY album ORDER BY place, key)) AS label FROM (SELECT l_orderkey AS album, l_partkey || '/' || l_suppkey AS key, l_linenumber AS place, CASE WHEN l_returnflag = 'R' THEN 'o' || l_orderkey END AS replaces
  FROM lineitem WHERE l_linenumber > 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY label) AS r FROM n) WHERE r = 1 AND key NOT IN (SELECT key FROM stored))
SELECT key, label, CASE WHEN label IN (SELECT replaces FROM f WHERE replaces IS NOT NULL) THEN 'superseded' ELSE status END AS status FROM stored UNION ALL SELECT key, label, 'proposed' FROM f""")
def load_batch_claims(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("/", C("l_partkey").cast("string"), C("l_suppkey").cast("string")))
    own = F.concat(F.lit("o"), C("l_orderkey").cast("string"))
    stored = lines.where("l_linenumber = 1").select("key", own.alias("label"), F.lit("accepted").alias("status"))
    new = lines.where("l_linenumber > 1").select(C("l_orderkey").alias("album"), "key", C("l_linenumber").alias("place"), F.when(C("l_returnflag") == "R", own).alias("replaces"))
    albums = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(C("o_orderkey").alias("album"))
    return claims.load_claims(stored, new, albums, "B1")


_ACTIONS = ("pin", "unpin", "bump", "snooze", "unsnooze", "hide", "unhide", "played")


@query(f"""WITH a AS (SELECT o_custkey AS item, {list(_ACTIONS)}[CAST(o_orderkey % 8 AS INTEGER) + 1] AS action, o_orderdate AS t, o_orderkey AS id FROM orders), e AS (SELECT max(o_orderdate) AS now FROM orders),
g AS (SELECT item, arg_max(action, row(t, id)) FILTER (WHERE action IN ('pin', 'unpin', 'hide')) AS pin, max(t) FILTER (WHERE action = 'bump') AS bump, arg_max(action, row(t, id)) FILTER (WHERE action IN ('snooze', 'unsnooze')) AS snooze,
  max(t) FILTER (WHERE action IN ('snooze', 'unsnooze')) AS snoozed_at, arg_max(action, row(t, id)) FILTER (WHERE action IN ('hide', 'unhide')) AS hide, count(DISTINCT t) FILTER (WHERE action = 'played') AS plays FROM a GROUP BY 1)
SELECT item, coalesce(pin = 'pin', false) AS pinned, coalesce(date_diff('day', CAST(bump AS DATE), CAST(now AS DATE)) < 200, false) AS bumped,
  coalesce(snooze = 'snooze' AND date_diff('day', CAST(snoozed_at AS DATE), CAST(now AS DATE)) < 400, false) AS snoozed, coalesce(hide = 'hide', false) AS hidden, plays FROM g, e""")
def queue_actions(spark, sf_dir):
    """Pins, bumps, snoozes, hiding and plays folded to states at the last order's day; long terms, as orders are sparse."""
    orders = table(spark, sf_dir, "orders")
    action = F.array(*map(F.lit, _ACTIONS))[(C("o_orderkey") % 8).cast("int")]
    log = orders.select(C("o_custkey").alias("item"), action.alias("action"), C("o_orderdate").alias("at"), C("o_orderkey").alias("id"))
    now = F.lit(orders.agg(F.max("o_orderdate")).first()[0])
    return claims.queue_states(log, "item", now, bump_days=200, snooze_days=400)


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS b FROM part), a AS (SELECT DISTINCT w AS a FROM (SELECT unnest(string_split(b, ' ')) AS w FROM n) UNION SELECT b FROM n)
SELECT a, b FROM a, n WHERE a <> '' AND b <> '' AND (a = b OR (length(a) <= length(b) AND length(a) >= 5 AND contains(b, a)) OR (length(b) < length(a) AND length(b) >= 5 AND contains(a, b)))""")
def same_names(spark, sf_dir):
    """Names, and words of names, against all names."""
    known = table(spark, sf_dir, "part").select(F.lower("p_name").alias("b")).distinct()
    asked = known.select(F.explode(F.split("b", " ")).alias("a")).union(known.select("b")).distinct()
    return claims.same_names(asked, known)
