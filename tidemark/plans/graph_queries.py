"""Graph queries over suppliers, parts and lines: edge resolution, neighbours, connection scores, threads, walk back, scope order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, relational
from ..sources.tables import insert_ignore, kept, remap_ids, table, upsert
from .registry import query

# An edge of supplier and part: one row of its lines, by source (flag), then confidence, then line.
_EDGE = """edge AS (SELECT l_suppkey AS src, l_partkey AS dst, l_orderkey AS claim, l_returnflag AS source, round(1 - l_discount, 2) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey
  ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, round(1 - l_discount, 2) DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1)"""


def _edges(spark, sf_dir) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_orderkey").alias("claim"), F.col("l_returnflag").alias("source"), F.round(1 - F.col("l_discount"), 2).alias("weight"), F.struct("l_orderkey", "l_linenumber").alias("line")
    )
    rank = F.when(F.col("source") == "R", 1).when(F.col("source") == "A", 2).otherwise(3)
    return graph.resolve_edges(claims, ["src", "dst"], rank, "weight", "line").drop("_rank", "line")


@query("WITH " + _EDGE + " SELECT * FROM edge")
def edge_resolution(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("WITH " + _EDGE + """ SELECT direction, other, weight FROM (SELECT 'out' AS direction, dst AS other, weight FROM edge WHERE src = 7 AND weight >= 0.92 UNION ALL SELECT 'in', src, weight FROM edge WHERE dst = 7 AND weight >= 0.92)
ORDER BY weight DESC, direction, other LIMIT 30""")
def neighbors_both_directions(spark, sf_dir):
    """The filters on src and dst reach the scan before edges are resolved."""
    return graph.neighbours(_edges(spark, sf_dir), F.lit(7), 30, 0.92)


# Albums are parts, nodes are suppliers; heard parts are seeds, brands are owners.
_PAIRS = "WITH " + _EDGE + """, seed AS (SELECT p_partkey AS seed, p_brand AS owner, p_size % 7 AS sessions FROM part WHERE p_partkey % 40 = 0), fan AS (SELECT src AS node, count(DISTINCT dst) AS fan FROM edge GROUP BY 1),
b AS (SELECT c.dst AS album, s.dst AS seed, c.src AS node, round(c.weight * s.weight * (1 / (1 + ln(1 + fan / 10.0))) * least(1.0, 0.5 + 0.1 * sessions), 4) AS value
  FROM edge c JOIN edge s ON s.src = c.src AND s.dst <> c.dst JOIN seed ON seed = s.dst JOIN fan ON node = c.src JOIN part ON p_partkey = c.dst WHERE p_brand <> owner AND p_partkey % 40 <> 0),
n AS (SELECT album, node, max(value) AS value FROM b GROUP BY ALL)"""


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (resolved once), links of finished albums, and owners of candidates."""
    parts = table(spark, sf_dir, "part")
    links = kept(_edges(spark, sf_dir).select(F.col("dst").alias("album"), F.col("src").alias("node"), "weight"), "links")
    finished = parts.where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("album"), (F.col("p_size") % 7).alias("sessions"), F.col("p_brand").alias("owner"))
    owners = parts.where("p_partkey % 40 <> 0").select(F.col("p_partkey").alias("album"), F.col("p_brand").alias("own"))
    return links, graph.seed_links(links, finished), owners


@query(_PAIRS + " SELECT album, round(sum(value), 4) AS score, count(*) AS nodes FROM n GROUP BY album")
def connection_scores(spark, sf_dir):
    return graph.connection_scores(graph.node_contributions(*_graph(spark, sf_dir)))


@query(_PAIRS + " SELECT album, node, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY album ORDER BY value DESC, node) AS INTEGER) AS rank FROM n) WHERE rank <= 3")
def connection_top3(spark, sf_dir):
    return relational.top_per(graph.node_contributions(*_graph(spark, sf_dir)), ["album"], 3, F.desc("value"), F.asc("node"))


@query(_PAIRS + """, t AS (SELECT seed, album, round(sum(value), 4) AS score FROM (SELECT seed, album, node, max(value) AS value FROM b GROUP BY ALL) GROUP BY ALL)
SELECT seed, album, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, album) AS INTEGER) AS rank FROM t) WHERE rank <= 20""")
def threads_top20(spark, sf_dir):
    return graph.threads(*_graph(spark, sf_dir), 20)


@query("WITH " + _EDGE + """, y AS (SELECT p_partkey AS id, p_size AS yr FROM part), hop AS (SELECT a.dst AS young, b.dst AS old, round(sum(round(a.weight * b.weight, 4)), 4) AS w FROM edge a JOIN edge b ON a.src = b.src AND a.dst <> b.dst JOIN y ya ON ya.id = a.dst JOIN y yb ON yb.id = b.dst
  WHERE yb.yr < ya.yr AND a.weight >= 0.97 AND b.weight >= 0.97 GROUP BY ALL),
h1 AS (SELECT old AS album, round(sum(w), 5) AS score FROM hop WHERE young % 100 = 0 GROUP BY 1), top AS (SELECT * FROM h1 ORDER BY score DESC, album LIMIT 15),
h2 AS (SELECT old AS album, round(0.5 * sum(w), 5) AS score FROM hop JOIN top ON top.album = young GROUP BY 1)
SELECT album, score FROM (SELECT album, round(sum(score), 5) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1) ORDER BY score DESC, album LIMIT 60""")
def walk_back(spark, sf_dir):
    """Older albums two steps back from the seeds; the second step starts from the best 15 of the first and counts half."""
    strong = _edges(spark, sf_dir).where("weight >= 0.97")
    years = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"), F.col("p_size").alias("yr"))
    dated = kept(strong.join(years, "dst").select("src", "dst", "weight", "yr"), "dated")
    return graph.walk_back(dated, F.col("young") % 100 == 0, seeds=15, factor=0.5, keep=60)


@query("WITH " + _EDGE + """, o AS (SELECT 1 AS source, p_partkey AS id FROM part WHERE p_size = 1 UNION ALL SELECT 2, dst FROM edge WHERE src = 1 UNION ALL SELECT 3, p_partkey FROM part WHERE p_retailprice > 1500)
SELECT id, CAST(min(source) AS INTEGER) AS source FROM o GROUP BY id""")
def default_scope_order(spark, sf_dir):
    """Several sources of work; the first place of an album wins."""
    parts = table(spark, sf_dir, "part")
    scope = lambda df, key, n: df.select(F.lit(n).alias("source"), F.col(key).alias("id"))
    every = scope(parts.where("p_size = 1"), "p_partkey", 1).union(scope(_edges(spark, sf_dir).where("src = 1"), "dst", 2)).union(scope(parts.where("p_retailprice > 1500"), "p_partkey", 3))
    return every.groupBy("id").agg(F.min("source").alias("source"))


@query("WITH " + _EDGE + """ SELECT r.dst AS album, count(DISTINCT r.src) AS fan_in FROM edge a JOIN edge b ON b.src = a.src JOIN edge r ON r.dst = b.dst WHERE a.dst = 11 AND a.weight > 0.95 GROUP BY 1""")
def expansion_fan_in(spark, sf_dir):
    """From an album to its nodes, to their albums, and how many nodes each of these has."""
    edges = _edges(spark, sf_dir)
    nodes = edges.where("dst = 11 and weight > 0.95").select("src").distinct()
    reached = edges.join(nodes, "src", "left_semi").select("dst").distinct()
    return edges.join(reached, "dst", "left_semi").groupBy(F.col("dst").alias("album")).agg(F.countDistinct("src").alias("fan_in"))


@query("""SELECT a.s_suppkey AS keep, b.s_suppkey AS merge FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND CAST(round(a.s_acctbal / 1000) AS INTEGER) = CAST(round(b.s_acctbal / 1000) AS INTEGER) AND a.s_suppkey < b.s_suppkey
WHERE EXISTS (SELECT 1 FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey WHERE x.l_suppkey = a.s_suppkey AND y.l_suppkey = b.s_suppkey)""")
def duplicate_entities(spark, sf_dir):
    """Entities of one key and class that share a context: gathered by key and context."""
    suppliers, lines = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    keyed = suppliers.select("s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") / 1000).cast("int").alias("k"))
    return graph.duplicate_pairs(keyed, ["s_nationkey", "k"], "s_suppkey", lines.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("WITH old AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 = 0), m AS (SELECT s_suppkey AS old_id, s_suppkey // 6 AS new_id FROM supplier WHERE s_suppkey % 2 = 0) SELECT s_nationkey, CASE WHEN new_id IS NOT NULL AND row_number() OVER (PARTITION BY new_id ORDER BY s_suppkey) = 1 THEN new_id END AS s_suppkey FROM old LEFT JOIN m ON old_id = s_suppkey")
def id_remap(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    mapping = suppliers.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("old_id"), F.expr("s_suppkey div 6").alias("new_id"))
    return remap_ids(suppliers.where("s_suppkey % 3 = 0").select("s_nationkey", "s_suppkey"), mapping, "s_suppkey")


@query("""SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(o.s_name, n.s_name) AS s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal FROM (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) o
FULL JOIN (SELECT s_suppkey, 'new ' || s_name AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0) n ON n.s_suppkey = o.s_suppkey""")
def upsert_entities(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = suppliers.where("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("new "), "s_name").alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return upsert(suppliers.where("s_suppkey % 3 <> 0"), new, ["s_suppkey"], keep_existing=["s_name"])


@query("WITH " + _EDGE + """, facets AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) t(facet)) SELECT p_partkey, facet FROM part CROSS JOIN facets WHERE NOT EXISTS (SELECT 1 FROM edge WHERE dst = p_partkey AND source = facet)""")
def facet_gaps(spark, sf_dir):
    """Facets without an accepted claim: each album's own list of facets, less those it has."""
    have = _edges(spark, sf_dir).groupBy(F.col("dst").alias("p_partkey")).agg(F.collect_set("source").alias("have"))
    every = F.array(*map(F.lit, ("A", "N", "R")))
    lacking = F.array_except(every, F.coalesce("have", F.array().cast("array<string>")))
    return table(spark, sf_dir, "part").select("p_partkey").join(have, "p_partkey", "left").select("p_partkey", F.explode(lacking).alias("facet"))


_SUPPORT = """c AS (SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey FROM lineitem), s AS (SELECT l_partkey, l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS n FROM c GROUP BY ALL)"""


@query("WITH " + _SUPPORT + " SELECT l_partkey, l_suppkey, l_returnflag, round(CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE least(CASE l_returnflag WHEN 'R' THEN 0.8 ELSE 0.5 END + 0.1 * (n - 1), 0.95) END, 2) AS confidence FROM s")
def claim_confidence(spark, sf_dir):
    """A base by kind, a tenth for each further independent source, at most 0.95; refuted claims have none."""
    support = graph.distinct_sources(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"], "l_orderkey")
    base = F.create_map(F.lit("R"), F.lit(0.8), F.lit("A"), F.lit(0.5))
    value = F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.least(base[F.col("l_returnflag")] + 0.1 * (F.col("n") - 1), F.lit(0.95)))
    return support.select("l_partkey", "l_suppkey", "l_returnflag", F.round(value, 2).alias("confidence"))


@query("""WITH t AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0) SELECT * FROM t UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0""")
def insert_missing_entities(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    new = suppliers.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.lit("new").alias("name"))
    return insert_ignore(suppliers.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), new, ["id"])


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version FROM orders)
SELECT o_custkey, o_orderkey, version, CASE WHEN version = max(version) OVER (PARTITION BY o_custkey) THEN 'ready' ELSE 'superseded' END AS state FROM d""")
def document_versions(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    numbered = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("version"))
    return numbered.withColumn("state", F.when(F.col("version") == F.max("version").over(w), "ready").otherwise("superseded"))
