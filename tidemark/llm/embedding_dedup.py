"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors become one with a weight. The vectors of a group (label) are assigned to the nearest of the centroids
that spherical k-means finds on a bounded sample; there are more centroids the more vectors a group has. A vector is
also sent, as a visitor, to every other cell whose border is near enough that a linked vector may lie beyond it: for
unit vectors x in cell c and y in cell d that link, |x - y| <= r = sqrt(2 - 2 * similarity), so y.(d - c) <= r |d - c|.
So no link is lost, and every pair of cells is compared in the lower of the two only. Cells are cut into blocks of
BLOCK vectors; a task compares two blocks at a time by one matrix product and gives back counts and a spanning forest,
not pairs. Components of the forests are the groups.

Cosines are exact in double precision; within 1e-9 of the threshold a pair is summed again term by term.
Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors with a null label
or of different lengths. Repeated rows of one id count as one vector (the first by its components). Rows without an id link
with nothing and are kept, one row each. Ties between representatives go to the least id. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import WorkTables, least_hashed

SIMILARITY = 0.98
#: Vectors per centroid aimed at; the most centroids of a group; sampled vectors per group for k-means.
CELL, MOST_CENTROIDS, SAMPLE = 2000, 2048, 20_000
BLOCK = 1024


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors; starts from evenly spaced rows, so the result is the same each time."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(1)
        for c in range(k):
            mean = vectors[nearest == c].sum(0)
            norm = np.linalg.norm(mean)
            if norm > 0:
                centroids[c] = mean / norm
    return centroids


def _unit(frame_vectors: pd.Series) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float64) for v in frame_vectors])


def _prepared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Usable vectors as bytes of doubles, with a digest of their components."""
    for frame in frames:
        out = []
        for key, label, v in zip(frame["id"], frame["label"], frame["embedding"]):
            try:
                x = np.asarray(v, np.float64) if v is not None and len(v) else None
            except TypeError:  # a null component
                x = None
            if x is not None and np.isfinite(x).all() and x.any():
                x = x + 0.0  # -0 and 0 are one
                out.append((key, label, len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), x.tobytes()))
        yield pd.DataFrame(out, columns=["id", "label", "size", "digest", "vector"])


def _compare(similarity: float):
    def linked(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray) -> np.ndarray:
        cosine = a @ b.T
        out = cosine >= similarity
        for i, j in np.argwhere(np.abs(cosine - similarity) < 1e-9):
            x, y = va[i].tolist(), vb[j].tolist()
            out[i, j] = sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)) >= similarity
        return out

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        """The vectors of two blocks (or of one, with itself): links of each vector, and edges of a spanning forest."""
        raw = _unit(frame["vector"])
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        side, home = frame["side"].to_numpy(), frame["home"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        link = linked(unit[left], unit[right], raw[left], raw[right])
        link &= home[left][:, None] | home[right][None, :]  # two visitors meet where one of them is at home
        if right is left:
            np.fill_diagonal(link, False)
        ids, weight = frame["id"].to_numpy(), frame["weight"].to_numpy()
        n = np.zeros(len(frame), np.int64)
        n[left] += link @ weight[right]
        if right is not left:
            n[right] += weight[left] @ link
        parent = np.arange(len(frame))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = [(int(i), int(c), None) for i, c in zip(ids, n) if c]
        for i, row in enumerate(link):
            for j in np.flatnonzero(row):
                a, b = root(left[i]), root(right[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(ids[left[i]]), 0, int(ids[right[j]])))
        return pd.DataFrame(out, columns=["id", "n", "other"]).astype({"other": "Int64"})

    return group


def dedup_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: n_links, component_id, kept. With a label column only equal labels are compared."""
    spark = vectors.sparkSession
    work = WorkTables(spark, "embedding_dedup")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    every = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    named = every.where("id is not null")
    everyone = named.select("id").distinct()
    usable = named.where("label is not null").mapInPandas(_prepared, "id long, label string, size int, digest binary, vector binary")
    once = usable.groupBy("id").agg(F.min(F.struct("label", "size", "digest", "vector")).alias("v")).select("id", "v.*")
    # The vector itself is not grouped by: its digest is, and the least id of a digest brings it along.
    once = work.keep(once)
    same = work.keep(once.groupBy("label", "size", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
    reps = once.join(same.select(F.col("rep").alias("id"), "weight"), "id").select("id", "label", "size", "vector", "weight")
    reps = work.keep(reps)
    # k-means on a bounded sample of every group
    ranked = least_hashed(reps.select("id", "label", "size"), ["label", "size"], "id", SAMPLE)
    totals = reps.groupBy("label", "size").count()

    def centroids(frame: pd.DataFrame) -> pd.DataFrame:
        x = _unit(frame.sort_values("rank")["vector"])
        k = int(min(MOST_CENTROIDS, max(1, len(x) // 2), math.ceil(frame["count"].iloc[0] / CELL)))
        found = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), k)
        return pd.DataFrame({"label": frame["label"].iloc[0], "size": frame["size"].iloc[0], "centroids": [found.tobytes()], "k": [k]})

    sample = reps.select("id", "vector").join(ranked, "id").join(F.broadcast(totals), ["label", "size"])
    models = work.keep(sample.groupBy("label", "size").applyInPandas(centroids, "label string, size int, centroids binary, k int"))
    reach = math.sqrt(2 - 2 * similarity) + 1e-9

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (name, size), part in frame.groupby(["label", "size"], sort=False):
                centers = np.frombuffer(part["centroids"].iloc[0], np.float64).reshape(-1, size)
                x = _unit(part["vector"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                dots = x @ centers.T
                home = dots.argmax(1)
                apart = np.linalg.norm(centers[:, None] - centers[None], axis=2)
                near = dots[np.arange(len(x)), home][:, None] - dots <= reach * apart[home]
                near &= np.arange(len(centers))[None] <= home[:, None]
                near[np.arange(len(x)), home] = True
                row, cell = np.nonzero(near)
                chosen = part.iloc[row]
                yield pd.DataFrame({"label": name, "size": size, "cell": cell, "home": cell == home[row], "id": chosen["id"].to_numpy(), "weight": chosen["weight"].to_numpy(), "vector": chosen["vector"].to_numpy()})

    placed = reps.join(F.broadcast(models), ["label", "size"]).mapInPandas(assign, "label string, size int, cell int, home boolean, id long, weight long, vector binary")
    placed = work.keep(placed)
    cells = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(cells), ["label", "size", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A block meets itself and every other block of its cell once.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    met = dealt.select("label", "size", "cell", "home", "id", "weight", "vector", "block", F.explode(meets).alias("m")).withColumn("side", (F.col("block") != F.col("m.low")).cast("int"))
    keyed = met.select(F.col("label").alias("g_label"), F.col("size").alias("g_size"), F.col("cell").alias("g_cell"), F.col("m.low").alias("low"), F.col("m.high").alias("high"), "home", "id", "weight", "vector", "side")
    found = work.keep(keyed.groupBy("g_label", "g_size", "g_cell", "low", "high").applyInPandas(_compare(similarity), "id long, n long, other long"))
    copies = once.join(same, ["label", "size", "digest"]).select("id", "rep", "weight")
    counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    # Copies hang on their representative, the least id of them, outside of the graph.
    parts = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), work)
    linked = copies.join(counts, "rep", "left").select("id", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    component = F.coalesce("component", "rep", "id")
    result = everyone.join(linked, "id", "left").join(parts, F.col("rep") == parts.node, "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
    nameless = every.where("id is null").select("id", F.lit(0).cast("long"), "id", F.lit(True))
    return result.union(nameless).withColumnRenamed("id", id_col)
