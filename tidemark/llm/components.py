"""Connected components of links, as DataFrame joins: no links are ever gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables, looked_up

#: Every round at least halves the nodes that still have links, so this many suffice for any graph that fits a cluster.
MAX_ROUNDS = 60
#: A node with more than one link in HUB_SHARE (and than HUB_LEAST) is a hub: at most 2 * HUB_SHARE nodes can be one.
HUB_SHARE, HUB_LEAST = 1000, 1000


def components(links: DataFrame, work: WorkTables) -> DataFrame:
    """The least node reachable from every node that has a link to another one: node, component.

    links: columns a and b (any sortable type; nulls and self links are ignored, repeated rows harmless). Each round maps
    every node to the least node within two steps and replaces all links by those of the images, until none is left: a
    star is one node after one round. Distributed union-find by hooking and contraction. An empty table of links gives an
    empty result.
    """
    edges = work.keep(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    for _ in range(MAX_ROUNDS):
        size = edges.count()
        if not size:
            break
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        near = work.keep(near.select("v", F.least("v", "m").alias("m"), (F.col("degree") > max(HUB_LEAST, size // HUB_SHARE)).alias("hub")))
        # The least of what is beside the neighbours; a node that is its own least neighbour's neighbour is among these.
        step = looked_up(both, "b", near).groupBy(F.col("a").alias("v")).agg(F.min("m").alias("to"))
        step = work.keep(step.join(near.select("v", "hub"), "v"))
        image = looked_up(looked_up(edges, "a", step).withColumnRenamed("to", "x"), "b", step).withColumnRenamed("to", "y")
        edges = work.keep(image.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        moved = step.select("v", "to")
        if labels is None:
            labels = work.keep(moved.select(F.col("v").alias("node"), F.col("to").alias("component")))
        else:
            labels = work.keep(labels.join(moved, labels.component == moved.v, "left").select("node", F.coalesce("to", "component").alias("component")))
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # A component's last image is one of its nodes, but not always the least one.
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
