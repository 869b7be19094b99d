"""Scores over a graph of albums, nodes and links, as fixed chains of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import damp, listen_factor
from ..sources.tables import broadcast_if_small, kept
from .relational import top_per


def resolve_edges(claims: DataFrame, key: list[str], rank: Column, confidence: str, id_col: str) -> DataFrame:
    """One claim for each key: best source, then confidence, then the least id."""
    return claims.withColumn("_rank", rank).groupBy(*key).agg(
        F.min_by(F.struct(*[c for c in claims.columns if c not in key]), F.struct("_rank", -F.col(confidence), F.col(id_col))).alias("_row")
    ).select(*key, "_row.*")


#: So many claims, about, are counted in one task.
CLAIMS_PER_TASK = 500_000


def distinct_sources(claims: DataFrame, fact: list[str], source: str) -> DataFrame:
    """n: how many different sources claim each fact. claims must be cheap to count, such as a table.

    Few claims are alike, so summing them up before the shuffle would fill a task with nearly all rows that it reads. They are
    dealt out by fact first, to as many tasks as their number asks for, and counted there.
    """
    rows = claims.select(*fact, source)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), claims.count() // CLAIMS_PER_TASK)
    return rows.repartition(tasks, *fact).groupBy(*fact).agg(F.countDistinct(source).alias("n"))


def neighbours(edges: DataFrame, node, k: int, least: float = 0.0) -> DataFrame:
    """Edges out of and into a node, best first."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "weight")
    back = edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "weight")
    return out.unionByName(back).where(F.col("weight") >= least).orderBy(F.desc("weight"), "direction", "other").limit(k)


#: Links of finished albums are sent to all tasks up to so many (about 60 bytes each); beyond, links are joined by a shuffle.
BROADCAST_SEEDS = 300_000


def seed_links(links: DataFrame, finished: DataFrame) -> DataFrame:
    """seed, node, seed_weight, sessions, seed_owner, fan: the links of finished albums, with how many albums share each node.

    links: album, node, weight. finished: album, sessions, owner. Only nodes that a finished album has are counted.
    """
    of = links.join(broadcast_if_small(kept(finished, "finished"), BROADCAST_SEEDS), "album")
    seeds = kept(of.select(F.col("album").alias("seed"), "node", F.col("weight").alias("seed_weight"), "sessions", F.col("owner").alias("seed_owner")), "seeds")
    nodes = broadcast_if_small(kept(seeds.select("node").distinct(), "nodes"), BROADCAST_SEEDS)
    fan = kept(links.join(nodes, "node", "left_semi").groupBy("node").agg(F.countDistinct("album").alias("fan")), "fans")
    return seeds.join(broadcast_if_small(fan, BROADCAST_SEEDS), "node")


def _value() -> Column:
    return F.round(F.col("weight") * F.col("seed_weight") * damp(F.col("fan")) * listen_factor(F.col("sessions")), 4)


def node_contributions(links: DataFrame, seeds: DataFrame, owners: DataFrame) -> DataFrame:
    """album, node, value: of every candidate the best contribution of each node it has a link to.

    links: album, node, weight, one row each. seeds as seed_links gives them. owners: album, own, for candidates only; albums
    of one owner don't count for each other. What a node contributes grows with the seed's own part, so of a node's seeds
    only the best one counts, or for its owner's albums the best one of another owner: two rows for each node, however many
    albums and seeds it has.
    """
    part = F.col("seed_weight") * listen_factor(F.col("sessions"))
    own = F.struct(part.alias("part"), "seed_weight", "sessions")
    by_owner = seeds.groupBy("node", "fan", "seed_owner").agg(F.max(own).alias("s"))
    best = by_owner.groupBy("node", "fan").agg(F.max(F.struct("s", "seed_owner")).alias("first"))
    other = by_owner.join(best, ["node", "fan"]).where(F.col("seed_owner") != F.col("first.seed_owner")).groupBy("node").agg(F.max("s").alias("second"))
    two = kept(best.join(other, "node", "left"), "best-seeds")
    met = links.join(owners, "album").join(broadcast_if_small(two, BROADCAST_SEEDS), "node")
    chosen = F.when(F.col("own") == F.col("first.seed_owner"), F.col("second")).otherwise(F.col("first.s"))
    return met.withColumn("s", chosen).where("s is not null").select("album", "node", "weight", "fan", "s.seed_weight", "s.sessions").select("album", "node", _value().alias("value"))


def connection_scores(contributions: DataFrame) -> DataFrame:
    """Each candidate's score: the best contribution of each node, summed."""
    return contributions.groupBy("album").agg(F.round(F.sum("value"), 4).alias("score"), F.count("*").alias("nodes"))


#: About so many pairs of seed and album are summed up in one block of seeds.
PAIRS_PER_BLOCK = 500_000
#: A node of more albums has several lists.
LIST_ALBUMS = 10_000


def threads(links: DataFrame, seeds: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """The k best connected albums of each finished one.

    Pairs of seed and album are many more than links and hardly any two are of one seed and album, so they are made, summed
    up and cut to k in one task and never shuffled. Seeds are parted into blocks, by range, so many as their pairs ask for.
    The candidates of a node go to each block that has seeds there, once, in one row of arrays with these seeds.
    """
    seeds = kept(seeds.withColumn("damped", damp(F.col("fan"))).withColumn("factor", listen_factor(F.col("sessions"))), "seed-links")
    blocks = (seeds.agg(F.sum("fan")).first()[0] or 0) // PAIRS_PER_BLOCK + 1
    blocked = kept(seeds.repartitionByRange(blocks, "seed").withColumn("block", F.spark_partition_id()), "seed-blocks")
    fans = seeds.groupBy("node").agg(F.max("fan").alias("fan"))
    part = F.pmod(F.xxhash64("album"), F.ceil(F.col("fan") / LIST_ALBUMS))
    owned = links.join(owners, "album").join(fans, "node").groupBy("node", part.alias("part"), "own").agg(F.sort_array(F.collect_list(F.struct("album", "weight"))).alias("l"))
    lists = owned.groupBy("node", "part").agg(F.collect_list(F.struct("own", F.col("l.album").alias("albums"), F.col("l.weight").alias("weights"))).alias("lists"))
    asking = blocked.groupBy("block", "node").agg(F.collect_list(F.struct("seed", "seed_weight", "seed_owner", "damped", "factor")).alias("seeds"))
    # Seeds travel with the lists: a join after this shuffle would deal the rows out by node as well, and the pairs again.
    sent = lists.join(asking, "node").select("block", "seeds", "lists").repartition(blocks, "block")
    met = sent.select("block", "seeds", F.explode("lists").alias("l")).select("block", "l", F.explode("seeds").alias("s")).where(F.col("l.own") != F.col("s.seed_owner"))
    pairs = met.select("block", "s.seed", "s.seed_weight", "s.damped", "s.factor", F.explode(F.arrays_zip("l.albums", "l.weights")).alias("e")).where("e.albums <> seed")
    value = F.round(F.col("e.weights") * F.col("seed_weight") * F.col("damped") * F.col("factor"), 4)
    scored = pairs.groupBy("block", "seed", F.col("e.albums").alias("album")).agg(F.round(F.sum(value), 4).alias("score"))
    return top_per(scored, ["block", "seed"], k, F.desc("score"), F.asc("album")).drop("block")


def related_pairs(tags: DataFrame, item: str, tag: str) -> DataFrame:
    """How often two tags stand on one item."""
    a, b = tags.select(item, F.col(tag).alias("tag_a")).distinct(), tags.select(item, F.col(tag).alias("tag_b")).distinct()
    return a.join(b, item).where("tag_a < tag_b").groupBy("tag_a", "tag_b").agg(F.count("*").alias("n"))


def walk_back(dated: DataFrame, is_seed: Column, seeds: int, factor: float, keep: int) -> DataFrame:
    """Scores of older albums one and two steps from the seeds. dated: src (node), dst (album), weight, yr. is_seed: a condition
    on young. Each step starts from the albums it is asked for, so no step is made from all albums."""
    young = dated.select("src", F.col("dst").alias("young"), F.col("weight").alias("w_young"), F.col("yr").alias("yr_young"))

    def hop(start: DataFrame) -> DataFrame:
        both = dated.join(broadcast_if_small(kept(start, "walk"), BROADCAST_SEEDS), "src").where((F.col("yr") < F.col("yr_young")) & (F.col("young") != F.col("dst")))
        return both.groupBy("young", F.col("dst").alias("album")).agg(F.round(F.sum(F.round(F.col("w_young") * F.col("weight"), 4)), 4).alias("w"))

    first = kept(hop(young.where(is_seed)).groupBy("album").agg(F.round(F.sum("w"), 5).alias("score")), "walk")
    top = first.orderBy(F.desc("score"), "album").limit(seeds).select(F.col("album").alias("young"))
    second = hop(young.join(F.broadcast(top), "young")).groupBy("album").agg(F.round(F.lit(factor) * F.sum("w"), 5).alias("score"))  # a few seeds
    summed = first.union(second).groupBy("album").agg(F.round(F.sum("score"), 5).alias("score"))
    return summed.orderBy(F.desc("score"), "album").limit(keep)


def duplicate_pairs(entities: DataFrame, key: list[str], id_col: str, contexts: DataFrame, context_id: str, context: str) -> DataFrame:
    """Pairs of entities with equal keys that stand in one context; each pair once, the lesser id kept.

    Entities are gathered by key and context, so a pair is made only where both stand, not for all pairs of a key times all of
    their contexts. Every two of one gathered set are a pair of the result: a set of n stands for n * (n - 1) / 2 of its rows.
    """
    stands = contexts.select(F.col(context_id).alias("id"), F.col(context).alias("context"))
    placed = entities.select(*key, F.col(id_col).alias("id")).join(stands, "id").where(F.col("context").isNotNull() & reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key)))
    sets = placed.groupBy(*key, "context").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    return sets.select("ids", F.explode("ids").alias("keep")).select("keep", F.explode("ids").alias("merge")).where("keep < merge").distinct()
