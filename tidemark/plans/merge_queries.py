"""Merges of entities and what comes with them, over the test tables: chains, choices, moved claims and links, and the way back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging
from ..sources.tables import table
from .registry import query

C = F.col

_PAIRS = "p AS (SELECT p_partkey AS gone, p_partkey - 1 - p_size % 7 AS keep FROM part WHERE p_partkey - 1 - p_size % 7 >= 1 AND p_retailprice % 3 < 2)"


def _chains(spark, sf_dir):
    keep = C("p_partkey") - 1 - C("p_size") % 7
    pairs = table(spark, sf_dir, "part").where((keep >= 1) & (C("p_retailprice") % 3 < 2)).select(C("p_partkey").alias("gone"), keep.alias("keep"))
    return merging.closure(pairs)


@query(f"""WITH RECURSIVE {_PAIRS}, walk AS (SELECT gone AS old_id, keep AS here FROM p UNION ALL SELECT old_id, p.keep FROM walk JOIN p ON p.gone = walk.here)
SELECT old_id, here AS new_id FROM walk WHERE here NOT IN (SELECT gone FROM p)""")
def merge_chains(spark, sf_dir):
    """Where every merged id ends, over chains of any length."""
    return _chains(spark, sf_dir)


#: Customers as entities (a third of them firm), orders as claims between two of them in one of some contexts.
_ENTITIES = """e AS (SELECT c_custkey AS id, c_nationkey * 100 + c_custkey % 7 AS key, CASE c_mktsegment WHEN 'BUILDING' THEN 'artist' WHEN 'MACHINERY' THEN 'person' ELSE c_mktsegment END AS kind, c_custkey % 3 = 0 AS firm FROM customer),
n AS (SELECT max(c_custkey) AS n FROM customer),
a AS (SELECT o_orderkey AS claim, o_custkey AS subject, CAST(o_orderkey * 7 % n.n + 1 AS BIGINT) AS object, o_custkey % 40 AS context, o_orderpriority AS predicate, o_orderkey % 2 AS source, CASE o_orderstatus WHEN 'P' THEN 'proposed' ELSE 'accepted' END AS status FROM orders, n),
s AS (SELECT DISTINCT subject AS id, context FROM a UNION SELECT object, context FROM a)"""
_CHOICES = _ENTITIES + """,
pr AS (SELECT l.id AS loose, f.id AS firm FROM e l JOIN e f ON l.key = f.key AND NOT l.firm AND f.firm AND (l.kind = f.kind OR (l.kind IN ('artist', 'person') AND f.kind IN ('artist', 'person')))),
mk AS (SELECT loose, firm, EXISTS (SELECT 1 FROM s x JOIN s y ON x.context = y.context WHERE x.id = loose AND y.id = firm) AS meets FROM pr),
ch AS (SELECT loose, firm, CASE WHEN c = 0 THEN 'none' WHEN c > 1 THEN 'several' WHEN meets THEN 'merge' ELSE 'apart' END AS outcome FROM (SELECT *, count(*) FILTER (meets) OVER (PARTITION BY loose) AS c FROM mk))"""


def _entities(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    kind = F.when(C("c_mktsegment") == "BUILDING", "artist").when(C("c_mktsegment") == "MACHINERY", "person").otherwise(C("c_mktsegment"))
    things = customer.select(C("c_custkey").cast("long").alias("id"), (C("c_nationkey") * 100 + C("c_custkey") % 7).alias("key"), kind.alias("kind"), (C("c_custkey") % 3 == 0).alias("firm"))
    n = customer.agg(F.max("c_custkey").alias("n"))
    status = F.when(C("o_orderstatus") == "P", "proposed").otherwise("accepted")
    claims = orders.crossJoin(F.broadcast(n)).select(  # one row
        C("o_orderkey").cast("long").alias("claim"), C("o_custkey").cast("long").alias("subject"), (C("o_orderkey") * 7 % C("n") + 1).cast("long").alias("object"),
        (C("o_custkey") % 40).cast("long").alias("context"), C("o_orderpriority").alias("predicate"), (C("o_orderkey") % 2).alias("source"), status.alias("status"),
    )
    links = customer.select(C("c_custkey").cast("long").alias("id"), F.concat(F.lit("u"), C("c_custkey") % 11).alias("url"))
    return things, claims, links


def _shared(claims):
    """Where things occur, and which kinds are alike."""
    shared = claims.select(C("subject").alias("id"), "context").union(claims.select("object", "context"))
    people = C("l.kind").isin("artist", "person") & C("f.kind").isin("artist", "person")
    return shared, people


@query("WITH " + _CHOICES + " SELECT * FROM ch")
def merge_choices(spark, sf_dir):
    """Loose entities with a firm namesake: merged if just one of these shares a context."""
    things, claims, _ = _entities(spark, sf_dir)
    return merging.choose_merges(things, *_shared(claims))


def _merged(spark, sf_dir):
    things, claims, links = _entities(spark, sf_dir)
    pairs = merging.chosen_merges(things, *_shared(claims))
    return merging.apply_merges(things, claims, links, merging.closure(pairs))


_MERGED = _CHOICES + """,
m AS (SELECT loose AS old_id, firm AS new_id FROM ch WHERE outcome = 'merge'),
mv AS (SELECT a.claim, coalesce(x.new_id, a.subject) AS subject, coalesce(y.new_id, a.object) AS object, coalesce(z.new_id, a.context) AS context, a.predicate, a.source, a.status, x.new_id IS NOT NULL OR y.new_id IS NOT NULL AS touched
  FROM a LEFT JOIN m x ON x.old_id = a.subject LEFT JOIN m y ON y.old_id = a.object LEFT JOIN m z ON z.old_id = a.context),
fs AS (SELECT *, coalesce(min(claim) FILTER (NOT touched) OVER w, min(claim) OVER w) AS stays FROM mv WINDOW w AS (PARTITION BY subject, object, predicate, source))"""


@query("WITH " + _MERGED + " SELECT claim, subject, object, context, CASE WHEN touched AND claim <> stays THEN 'superseded' ELSE status END AS status FROM fs")
def merged_claims(spark, sf_dir):
    """Claims after the merges: moved, and superseded where another one says the same."""
    return _merged(spark, sf_dir).claims.select("claim", "subject", "object", "context", "status")


@query("WITH " + _ENTITIES + " SELECT claim, subject, object, context, status FROM a")
def unmerged_claims(spark, sf_dir):
    """All merges taken back by their log: the claims as they were."""
    return merging.undo_merges(_merged(spark, sf_dir)).claims.select("claim", "subject", "object", "context", "status")


@query("WITH " + _MERGED + """, l AS (SELECT c_custkey AS id, 'u' || (c_custkey % 11) AS url FROM customer)
SELECT DISTINCT coalesce(m.new_id, l.id) AS id, url FROM l LEFT JOIN m ON m.old_id = l.id""")
def merged_links(spark, sf_dir):
    """Links after the merges: those of what went are the kept ones' now, each once."""
    return _merged(spark, sf_dir).links
