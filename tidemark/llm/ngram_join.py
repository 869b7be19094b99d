"""N-gram Jaccard join: which documents share 80 % of their five-word shingles, and the components of these links.

Shingles are ordered rare first: by the number of documents that have them, then by hash. Two sets that are similar
enough share a shingle within their prefixes in this order. Since a shingle of one document only can't be shared, a
document whose prefix holds no other drops out.

1. Each batch of documents is cut into shingle hashes; hashes go, packed by range of hash, to the task that counts this
   range. What a batch holds twice is sent once with its count, so a very frequent shingle is a few numbers per batch.
2. The shared hashes go back to their batch with their counts, and each document keeps its shared hashes, rarest first,
   if its prefix holds any.
3. Documents with equal sets are one from here on. The prefixes' hashes are joined: first to one leading document of
   each hash, then to another one drawn by hash, then (components of these links being known) between different
   components only. Length, positional and suffix filters bound the overlap; pairs left are verified once with their
   whole sets. The suffix filter parts the sets by fixed ranges of hash rather than by pivots, and adds up the smaller
   part of every range: an upper bound of the overlap from 256 bytes a document.

Sets are compared by the 64-bit hashes of their shingles; two different shingles of a pair of documents of 600 shingles
are equal with a probability of 2e-14. Null, empty or wordless texts have no shingles and link with nothing; fewer words
than five are one shingle. Very long texts are batches of their own. Rows without an id give rows without a component and
link with nothing. Of a repeated id each row's set counts: what any of them links to is linked to the id, and n_shingles
is the largest. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .components import components
from .shared import WorkTables

WORDS, PERCENT = 5, 80
BATCH_BYTES, BATCH_DOCS = 8_000_000, 60_000
HASHED_BYTES = 500_000
BINS = 128
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of these texts, and how many words each text has. Hashing takes about 50 bytes for each byte of text,
    so texts are hashed a few at a time; a word's hash does not depend on its place."""
    sizes = np.cumsum([len(c) for c in coded])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // HASHED_BYTES)) + 1).tolist(), len(coded)]
    hashes, counts = zip(*(_hashed(coded[a:b]) for a, b in zip(cuts[:-1], cuts[1:])))
    return np.concatenate(hashes), np.concatenate(counts)


def _hashed(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(c) + 1 for c in coded], np.int64)
    buf = _LOWER[np.frombuffer(b" ".join(coded) + b" ", np.uint8)]
    inside = ~_SPACE[buf]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    # the sum of (byte + 1) * R^place is a polynomial hash; dividing the place out by an inverse power makes it free of it
    size = len(buf)
    power = np.full(size, 0xD6E8FEB86659FD93, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([[np.uint64(0)], np.add.accumulate((buf.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.full(size, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    hashes = _mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _MIX)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, one text after the other, sorted; and how many each has."""
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    n = len(words)
    doc = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(counts, WORDS)[doc]
    acc = np.zeros(n, np.uint64)
    for k in range(WORDS):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = words[k:]
        acc = np.where(k < length, (acc + shifted) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k + 1), acc)
    first = position <= counts[doc] - length
    hashes, doc = _mixed(acc[first] + length[first].astype(np.uint64) * _MIX), doc[first]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(texts))


_SENT = "bucket long, batch long, kind int, hashes binary, extra binary, df binary"


def _cut(bits: int):
    """Batches of documents to packed hashes by range. Kind 0: hashes once in the batch, with document numbers; 1: more often, with counts; 4: the same, by document, for the batch itself; 3: the batch's documents (ids and numbers of shingles)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A batch is named by its task's partition and its place there; the rows are written once, so names hold.
        task, made = TaskContext.get().partitionId(), 0
        for frame in frames:
            texts, ids, low = frame["text"].tolist(), frame["id"].to_numpy(np.int64), 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and high - low < BATCH_DOCS and (size < BATCH_BYTES or high == low):
                    size += len(texts[high] or "")
                    high += 1
                made += 1
                yield batch(texts[low:high], ids[low:high], task << 31 | made)
                low = high

    def batch(texts: list, ids: np.ndarray, name: int) -> pd.DataFrame:
        hashes, counts = shingle_sets(texts)
        doc = np.repeat(np.arange(len(ids), dtype=np.uint16), counts)
        order = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
        times = np.diff(np.append(new, len(hashes)))
        once = np.repeat(times == 1, times)
        out = [(-1 - name, name, 3, ids.tobytes(), counts.astype(np.int32).tobytes(), b""), (-1 - name, name, 4, hashes[~once].tobytes(), doc[~once].tobytes(), b"")]
        for kind, h, extra in ((0, hashes[once], doc[once]), (1, hashes[new[times > 1]], times[times > 1].astype(np.uint16))):
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]]) if len(h) else []
            out += [(int(bucket[a]), name, kind, h[a:b].tobytes(), extra[a:b].tobytes(), b"") for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame(out, columns=["bucket", "batch", "kind", "hashes", "extra", "df"])

    return rows


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts one range. Back go, by batch, the shared hashes with their counts: with documents (kind 2), or those that the batch has several times (kind 5)."""
    if frame["bucket"].iloc[0] < 0:
        return frame
    held = [np.frombuffer(x, np.uint64) for x in frame["hashes"]]
    times = [np.ones(len(h), np.int64) if kind == 0 else np.frombuffer(x, np.uint16).astype(np.int64) for h, kind, x in zip(held, frame["kind"], frame["extra"])]
    _, where = np.unique(np.concatenate(held), return_inverse=True)
    df = np.bincount(where, np.concatenate(times))[where].astype(np.uint32)
    out, at = [], 0
    for h, kind, batch, extra in zip(held, frame["kind"], frame["batch"], frame["extra"]):
        own = df[at : at + len(h)]
        at += len(h)
        mine = own > 1
        if mine.any():
            docs = np.frombuffer(extra, np.uint16)[mine].tobytes() if kind == 0 else b""
            out.append((-1 - batch, batch, 2 if kind == 0 else 5, h[mine].tobytes(), docs, own[mine].tobytes()))
    return pd.DataFrame(out, columns=["bucket", "batch", "kind", "hashes", "extra", "df"])


_SETS = "id long, n int, own float, digest binary, shared binary, prefix array<long>, at array<int>, bins binary"


def _sets(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of one batch whose prefix holds a shared hash."""
    join = lambda kind, column, t: np.frombuffer(b"".join(frame[column][frame["kind"] == kind]), t)
    ids, sizes = join(3, "hashes", np.int64), join(3, "extra", np.int32)
    several, counts, inner = join(5, "hashes", np.uint64), join(5, "df", np.uint32), join(4, "hashes", np.uint64)
    order = np.argsort(several)
    h = np.concatenate([join(2, "hashes", np.uint64), inner])
    df = np.concatenate([join(2, "df", np.uint32), counts[order][np.searchsorted(several[order], inner)]])
    doc = np.concatenate([join(2, "extra", np.uint16), join(4, "extra", np.uint16)])
    order = np.lexsort((h, df, doc))
    h, doc = h[order], doc[order]
    shared = np.bincount(doc, minlength=len(ids))
    ends = np.cumsum(shared)
    out = []
    for i in np.flatnonzero(shared):
        n, u = int(sizes[i]), int(sizes[i] - shared[i])
        length = n - (PERCENT * n + 99) // 100 + 1
        own = h[ends[i] - shared[i] : ends[i]]
        if u < length:
            data = own.tobytes()
            digest = hashlib.blake2b(data if u == 0 else str(ids[i]).encode(), digest_size=16).digest()
            bins = np.bincount((own % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype(np.uint32).tobytes()
            out.append((int(ids[i]), n, u / n, digest, data, own[: length - u].astype(np.int64).tolist(), list(range(u, length)), bins))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _SETS.split(", ")])


def _sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for ids, n in zip(frame["hashes"], frame["extra"]):
            yield pd.DataFrame({"id": np.frombuffer(ids, np.int64), "n": np.frombuffer(n, np.int32).astype(np.int64)})


def _nameless(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"n": shingle_sets(frame["text"].tolist())[1].astype(np.int64)})


def _need(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of these sizes: 100 * o >= 80 * (n_a + n_b - o)."""
    return -(-PERCENT * (n_a.astype(np.int64) + n_b) // (100 + PERCENT))


@F.pandas_udf(BooleanType())
def _bins_allow(n_a: pd.Series, n_b: pd.Series, bins_a: pd.Series, bins_b: pd.Series) -> pd.Series:
    if not len(n_a):
        return pd.Series([], dtype=bool)
    a, b = (np.frombuffer(b"".join(x), np.uint32).reshape(len(n_a), BINS) for x in (bins_a, bins_b))
    return pd.Series(np.minimum(a, b).sum(1, dtype=np.int64) >= _need(n_a.to_numpy(), n_b.to_numpy()))


@F.pandas_udf(BooleanType())
def _verified(n_a: pd.Series, n_b: pd.Series, shared_a: pd.Series, shared_b: pd.Series) -> pd.Series:
    overlap = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(shared_a, shared_b)]
    return pd.Series(np.array(overlap, np.int64) >= _need(n_a.to_numpy(), n_b.to_numpy()), dtype=bool)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verifies candidate pairs (a, b), each once."""
    light, whole = sets.select("id", "n", "bins"), sets.select("id", "shared")
    side = lambda df, k: df.select(*(F.col(c).alias(f"{c}_{k}") for c in df.columns))
    kept = pairs.join(side(light, "a"), F.col("a") == F.col("id_a")).join(side(light, "b"), F.col("b") == F.col("id_b"))
    kept = kept.where(_bins_allow("n_a", "n_b", "bins_a", "bins_b")).select("a", "b", "n_a", "n_b")
    kept = kept.join(side(whole, "b"), F.col("b") == F.col("id_b")).join(side(whole, "a"), F.col("a") == F.col("id_a"))
    return kept.where(_verified("n_a", "n_b", "shared_a", "shared_b")).select("a", "b")


def _possible(x: str, y: str) -> Column:
    """Length filter, and positional filter: a pair is only wanted at the first hash that both have (in the common order),
    and from there on at most what stands behind it on either side can be shared."""
    (n_x, at_x), (n_y, at_y) = ([F.col(f"{side}{c}") for c in ("n", "at")] for side in (x, y))
    need = F.ceil(PERCENT * (n_x + n_y) / (100 + PERCENT))
    return (100 * F.least(n_x, n_y) >= PERCENT * F.greatest(n_x, n_y)) & (F.least(n_x - at_x, n_y - at_y) >= need)


def _mixed_entries(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Entries with their component c, only of hashes that several components have: others need no more work."""
    labelled = entries.join(parts, entries.id == parts.node, "left").select("id", "n", "h", "at", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h")
    return labelled.join(mixed, "h", "left_semi")


def join_ngrams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (the least id reachable by links, itself included)."""
    spark = docs.sparkSession
    work = WorkTables(spark, "ngram_join")
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = every.where("id is not null")
    n_docs = texts.select("id").count()
    bits = max(4, int(np.ceil(np.log2(max(n_docs, 1) / 512))) if n_docs > 512 else 4)
    sent = texts.mapInPandas(_cut(bits), _SENT)
    back = work.keep(sent.groupBy("bucket").applyInPandas(_count, _SENT))
    sets = work.keep(back.where("kind > 1").where("kind <> 3 or length(hashes) > 0").groupBy("batch").applyInPandas(_sets, _SETS))
    sizes = work.keep(back.where("kind = 3").mapInPandas(_sizes, "id long, n long").groupBy("id").agg(F.max("n").alias("n")))
    work.drop(back)
    same = sets.groupBy("digest").agg(F.min("id").alias("rep"))
    # Documents with equal sets hang on their representative outside of the graph; only a repeated id can have several.
    stands = sets.select("id", "digest").join(same, "digest").select("id", "rep")
    lowest = work.keep(stands.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")))
    copies = lowest.where("rep <> last").select("id", F.col("rep").alias("a")).join(stands.select("id", F.col("rep").alias("b")), "id").where("a <> b").select("a", "b")
    entries = work.keep(
        sets.join(same, "digest").where("id = rep")
        .select("id", "n", "own", F.explode(F.arrays_zip("prefix", "at")).alias("p"))
        .select("id", "n", "own", F.col("p.prefix").alias("h"), F.col("p.at").alias("at"))
        .repartition("h")
    )
    # The document with the smallest share of shingles of its own leads: of a text and its edited copies, this is the text.
    leader = entries.groupBy("h").agg(F.min(F.struct("own", "id", "n", "at")).alias("l"), F.count("*").alias("m")).where("m > 1")
    star = entries.join(leader, "h").where("id <> l.id").where(_possible("", "l.")).select(F.least("l.id", "id").alias("a"), F.greatest("l.id", "id").alias("b")).distinct()
    found = work.keep(_links(star, sets).union(copies))
    parts = work.keep(components(found, work))
    # Of a large group of edited copies some are not near the first leader. Each hash gets another leader, drawn by hash, so
    # a document meets many of its group, and most of the group is one component before the rest is compared in pairs.
    labelled = work.keep(_mixed_entries(entries, parts))
    drawn = labelled.groupBy("h").agg(F.min(F.struct(F.xxhash64("id", "h"), "id", "n", "at", "c")).alias("l"))
    again = labelled.join(drawn, "h").where(F.col("c") != F.col("l.c")).where(_possible("", "l.")).select(F.least("l.id", "id").alias("a"), F.greatest("l.id", "id").alias("b")).distinct()
    again = work.keep(again.join(star, ["a", "b"], "left_anti"))
    closer = work.keep(_links(again, sets))
    if closer.limit(1).count():
        found = found.union(closer)
        parts = work.keep(components(found, work))
        labelled = work.keep(_mixed_entries(labelled.drop("c"), parts))
    x, y = labelled.alias("x"), labelled.alias("y")
    across = (
        x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & _possible("x.", "y."))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        .join(star.union(again), ["a", "b"], "left_anti")
    )
    more = work.keep(_links(across, sets))
    if more.limit(1).count():
        parts = work.keep(components(found.union(more), work))
    work.only(sizes, lowest, parts)
    found = sizes.join(lowest.select("id", "rep"), "id", "left").withColumn("rep", F.coalesce("rep", "id")).join(parts, F.col("rep") == parts.node, "left")
    named = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    none = F.lit(None).cast("long")
    return named.union(every.where("id is null").mapInPandas(_nameless, "n long").select(none, "n", none))
