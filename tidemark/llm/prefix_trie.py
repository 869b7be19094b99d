"""Prefix trie of conversations by Patricia construction.

Turns become digests and word counts; a conversation is the array of these. Equal conversations are one sequence from
here on. Sequences are sorted by range, and only branches, ends and leaves become points, with compressed edges between
them (patricia.py); members, least conversation, leaves and saved words are summed up on this compressed tree. In the end
each edge gives its unary nodes back: all figures of a node inside an edge are those of the point below, but for the saved
words, which grow by a suffix sum of the edge's word counts.

What ranges share are the nodes between two of them; their figures are summed up by key. The words that a node saves are
the words of its members' turns from its own on, less the words of the nodes from it on: both are plain sums, so ranges can
be added without knowing a node's total. Conversations that end in one node may be any number: their ids are sorted by range
into blocks of text, and one digest reads a node's blocks in order.

Turns and sequences are compared by SHA-256 digests of role and text. Null ids are ignored; a null turn comes first; null
role or text is empty; turns of one number are ordered by role and text; repeated rows are turns of their own. Texts of any
length are one digest; a conversation is one array of these, 40 bytes a turn. Other columns don't matter, whatever their
names. An empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .patricia import compressed, in_ranges
from .shared import WorkTables, looked_up

WORD = r"[^\x20\x09-\x0D]+"
#: Ids of one node are joined to text in blocks of so many.
BLOCK_IDS = 10_000
#: A node with more than one child in HUB_SHARE (and than HUB_LEAST) is looked up by broadcast: HUB_SHARE nodes at most.
HUB_SHARE, HUB_LEAST = 1000, 1000
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_BUILT = "whole boolean, key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, total long, once long, sums array<long>"


def conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of d: digest, w: words), one row for each conversation, in order."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), as_text(role_col).alias("role"), as_text(text_col).alias("text")).where("conv_id is not null")
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    one = placed.select("conv_id", F.struct("at", digest.alias("d"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("w")).alias("turn"))
    ordered = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def with_shared_heads(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % every, in place of its own first h:
    h = crc32(c) % most. convs: conv_id, turns; read twice, so a work table."""
    h = F.expr(f"cast(crc32(cast(conv_id as string)) % {most} as int)")
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    joined = own.join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", 1, F.col("h")), none), rest).alias("turns"))


def _named(convs: DataFrame) -> DataFrame:
    """conv_id, key (of the whole sequence: each turn's digest joined to the key before it), turns."""
    chained = F.aggregate("turns", F.lit(b""), lambda key, t: F.unhex(F.sha2(F.concat(key, t["d"]), 256)))
    return convs.select("conv_id", chained.alias("key"), "turns")


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _BUILT.split(", ")]

    def rows(batches):
        for batch in batches:
            for pid, kind, d, w, n, least in zip(batch["pid"], batch["kind"], batch["ds"], batch["ws"], batch["n"], batch["least"]):
                yield pid, (kind, list(d), [] if w is None else list(w), n, least)

    def one_range(first, pid):
        nonlocal pending
        yield first
        for at, row in stream:
            if at != pid:
                pending = at, row
                return
            yield row
        pending = None

    stream, out = rows(batches), []
    pending = next(stream, None)
    while pending:
        pid, first = pending
        source = one_range(first, pid)
        for whole, _, keys, top, p, weights in compressed(source, b"", lambda key, d: hashlib.sha256(key + d).digest()):
            edge = [int(x) for x in weights[top : p.depth - 1]] if whole else []
            sums = [*accumulate(reversed(edge), initial=0)][::-1]
            out.append((whole, keys[p.depth], keys[top] if top >= 0 else None, p.depth, p.least, p.n, p.children, p.leaves, p.total, p.once, sums))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        for _ in source:
            pass
    yield pd.DataFrame(out, columns=columns)


def _ends(named: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the ids, ascending and joined by commas, of the conversations that end in a node."""
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = named.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = 0
        for batch in batches:
            out = []
            for key, group in batch.groupby("key", sort=False)["conv_id"]:
                ids = group.tolist()
                for low in range(0, len(ids), BLOCK_IDS):
                    made += 1
                    out.append((key, TaskContext.get().partitionId(), made, ",".join(map(str, ids[low : low + BLOCK_IDS]))))
            yield pd.DataFrame(out, columns=["key", "pid", "block", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch["key"], batch["ids"]):
                if key != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=["key", "ends_sha256"])

    made = ordered.mapInPandas(blocks, "key binary, pid int, block int, ids string")
    return made.repartition(parts, "key").sortWithinPartitions("key", "pid", "block").mapInPandas(digests, "key binary, ends_sha256 string")


def build(convs: DataFrame) -> DataFrame:
    """One row for every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: conv_id (different ones), turns as of conversations().
    """
    work = WorkTables(convs.sparkSession, "prefix_trie")
    named = work.keep(_named(convs))
    different = named.groupBy("key").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    sequences = different.select(F.transform("turns", lambda t: t["d"]).alias("ds"), F.transform("turns", lambda t: t["w"]).alias("ws"), "n", "least")
    built = work.keep(in_ranges(sequences, "ds", work).select("pid", "kind", "ds", "ws", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "least"))).mapInPandas(_edges, _BUILT))

    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "total", "once")]
    spine = built.where("not whole").groupBy("key", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *total, F.first("sums").alias("sums"))
    points = work.keep(built.where("whole").drop("whole").unionByName(spine).withColumn("saved", F.col("total") - F.col("once")))
    hub = F.col("n_children") > max(HUB_LEAST, points.count() // HUB_SHARE)
    above = points.select(F.col("key").alias("v"), F.col("conv_id").alias("above"), hub.alias("hub"))
    below = looked_up(points.where("parent is not null"), "parent", above)
    both = below.unionByName(points.where("parent is null").withColumn("above", F.lit(None).cast("long")))
    both = both.join(_ends(named), "key", "left")

    size = F.size("sums")
    nodes = both.select("*", size.alias("size"), F.posexplode("sums").alias("i", "more"))
    last, first = F.col("i") == F.col("size") - 1, F.col("i") == 0
    return nodes.select(
        "conv_id",
        (F.col("depth") - F.col("size") + 1 + F.col("i")).alias("depth"),
        F.when(first, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("more")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(_NO_ENDS))).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
