"""Removal of long byte strings that an earlier document holds, with a difference-cover sample of suffixes.

Only the first LENGTH bytes of suffixes decide here, so the suffix order is needed to that depth. Places in a residue
class of the difference cover DIFFERENCES modulo PERIOD are sampled: for any two places there is a step of less than
PERIOD that takes both to sampled ones. So two equal strings of LENGTH bytes hold equal sampled tuples of
LENGTH - PERIOD + 1 bytes.

1. Equal documents: all but the one with the least id go as a whole (if they are long enough).
2. Sampled tuples are named and sorted, by ranges of names; a tuple with a twin is marked.
3. The remaining suffixes are merged in only where a marked tuple lies within reach: their LENGTH-byte prefixes are
   named and sorted, by ranges, and equal neighbours in that order are compared: a prefix that also starts in a document
   with a smaller id is removed. Since a tuple and its step decide a prefix, no recursion over names is needed.

Every batch of documents sends each name once, whatever its number of copies, so one very frequent string is a few
bytes per batch. Names are hashes of 64 bits and more; sampled names, of 5 bytes beside their range, only choose
what is looked at closely.

Null texts are empty; texts shorter than LENGTH lose nothing. Rows with a null id are compared with nothing and lose
nothing. Rows of one id are one document: none of them counts as earlier than another. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables, broadcast_if_small

LENGTH, PERIOD = 50, 31
#: A perfect difference set: every residue but 0 is a difference of two of them, once.
DIFFERENCES = (1, 5, 11, 24, 25, 27)
TUPLE = LENGTH - PERIOD + 1
BATCH_DOCS, RANGE_BATCHES = 1000, 1
BROADCAST_IDS = 500_000
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes from every place on, length of them; spans double from step to step."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    part, size = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1
    out, done = None, 0
    while True:
        if length & size:
            if out is None:
                out, done = part, size
            else:
                n = max(len(data) - done - size + 1, 0)
                out, done = out[:n] * power(size) + part[done : done + n], done + size
        if size * 2 > length:
            return _mixed(out)
        part = part[:-size] * power(size) + part[size:] if len(part) > size else part[:0]
        size *= 2


class _Batch:
    """Documents of a batch in one buffer, by id."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("id", kind="stable")
        self.texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in frame["text"]]
        self.ids = frame["id"].to_numpy(np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.low = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places whose tuple fits into their document, and the tuples' names."""
        chosen = np.zeros(PERIOD, bool)
        chosen[list(DIFFERENCES)] = True
        fits = np.ones(len(self.data), bool)
        for k in range(1, TUPLE):
            short = self.sizes >= k
            fits[(self.low + self.sizes - k)[short]] = False
        place = np.arange(len(self.data)) - np.repeat(self.low, self.sizes)
        at = np.flatnonzero(chosen[place % PERIOD] & fits)
        return at, windows(self.data, TUPLE)[at] if len(at) else np.zeros(0, np.uint64)

    def prefixes(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose prefix reaches a marked tuple and fits into their document; the prefixes' names; the documents."""
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, np.maximum(marked - PERIOD + 1, 0), 1)
        np.add.at(step, marked + 1, -1)
        near = np.cumsum(step[:-1]) > 0
        for k in range(1, LENGTH):
            short = self.sizes >= k
            near[(self.low + self.sizes - k)[short]] = False
        at = np.flatnonzero(near)
        names = windows(self.data, LENGTH)[at] if len(at) else np.zeros(0, np.uint64)
        return at, names, np.searchsorted(self.low, at, side="right") - 1




def _ranges(names: np.ndarray, bits: int) -> np.ndarray:
    return (names >> np.uint64(64 - bits)).astype(np.int64)


def _pack(names: np.ndarray, size: int) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


_SENT = "range long, batch long, names binary, ids binary, runs binary"
_BITS = "range long, batch long, bits binary"


def _bits_of(frame: pd.DataFrame, sizes: np.ndarray) -> np.ndarray:
    """The bits of all ranges of a batch, in the order in which names were sent."""
    bits = dict(zip(frame["range"].tolist(), frame["bits"]))
    parts = [np.unpackbits(np.frombuffer(bits[r], np.uint8), count=int(n)) for r, n in enumerate(sizes) if n]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _tuples(bits: int):
    def group(frame: pd.DataFrame) -> pd.DataFrame:
        _, names = _Batch(frame).sample()
        once = np.unique(names)
        cuts = np.searchsorted(_ranges(once, bits), np.arange((1 << bits) + 1))
        batch = int(frame["batch"].iloc[0])
        out = [(r, batch, _pack(once[a:b], 5), b"", b"") for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pd.DataFrame(out, columns=["range", "batch", "names", "ids", "runs"])

    return group


def _twins(frame: pd.DataFrame) -> pd.DataFrame:
    """Which tuples of a range occur in several batches."""
    parts = [_unpack(x, 5) for x in frame["names"]]
    _, where, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twin = times[where] > 1
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"range": frame["range"], "batch": frame["batch"], "bits": [np.packbits(twin[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)]})


def _marked(batch: _Batch, tuples: pd.DataFrame, bits: int) -> np.ndarray:
    at, names = batch.sample()
    once, where, times = np.unique(names, return_inverse=True, return_counts=True)
    twin = _bits_of(tuples, np.bincount(_ranges(once, bits), minlength=1 << bits)) | (times > 1)
    return at[twin[where]] if len(at) else at


def _sent_prefixes(batch: _Batch, tuples: pd.DataFrame, bits: int):
    """Places, documents, and for each place the number of its name in the order of sending; each name with its least id."""
    at, names, doc = batch.prefixes(_marked(batch, tuples, bits))
    once, first, where = np.unique(names, return_index=True, return_inverse=True)  # places rise with ids, so the first is the least
    order = np.lexsort((once, batch.ids[doc[first]], _ranges(once, bits))) if len(once) else np.zeros(0, int)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return at, doc, number[where] if len(at) else where, once[order], batch.ids[doc[first]][order] if len(at) else np.zeros(0, np.int64)


def _prefixes(bits: int):
    def group(docs: pd.DataFrame, tuples: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs):
            _, _, _, names, ids = _sent_prefixes(_Batch(docs), tuples, bits)
            cuts = np.searchsorted(_ranges(names, bits), np.arange((1 << bits) + 1))
            batch = int(docs["batch"].iloc[0])
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if b > a:
                    own = ids[a:b]
                    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    out.append((r, batch, _pack(names[a:b], 7), own[starts].tobytes(), np.diff(np.append(starts, b - a)).astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=["range", "batch", "names", "ids", "runs"])

    return group


def _earlier(frame: pd.DataFrame) -> pd.DataFrame:
    """Which prefixes of a range start in a document with a smaller id, in any batch."""
    parts = [_unpack(x, 7) for x in frame["names"]]
    names = np.concatenate(parts)
    ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.int32)) for i, n in zip(frame["ids"], frame["runs"])])
    order = np.lexsort((ids, names))
    ordered = names[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), np.arange(len(order)), 0))
    earlier = np.empty(len(order), bool)
    earlier[order] = ids[order[head]] < ids[order]
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"range": frame["range"], "batch": frame["batch"], "bits": [np.packbits(earlier[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)]})


def _cut(bits: int):
    def group(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs):
            batch = _Batch(docs)
            at, doc, number, names, ids = _sent_prefixes(batch, found[found["tuple"]], bits)
            earlier = _bits_of(found[~found["tuple"]], np.bincount(_ranges(names, bits), minlength=1 << bits))
            starts = at[earlier[number] | (ids[number] < batch.ids[doc])] if len(at) else at
            step = np.zeros(len(batch.data) + 1, np.int32)
            step[:-1][starts] += 1
            np.subtract.at(step, starts + LENGTH, 1)
            gone = np.cumsum(step[:-1]) > 0
            for key, low, size, text in zip(batch.ids.tolist(), batch.low.tolist(), batch.sizes.tolist(), batch.texts):
                own = gone[low : low + size]
                n = int(own.sum())
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                out.append((key, size, n, spans, np.frombuffer(text, np.uint8)[~own].tobytes() if n else text))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return group


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: n_bytes, n_removed, n_spans (long), kept (binary: the bytes left, joined)."""
    work = WorkTables(docs.sparkSession, "repeats")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    whole = named.where("id is not null")
    digests = work.keep(whole.where(F.octet_length("text") >= LENGTH).select("id", F.xxhash64("text").alias("x"), F.md5("text").alias("m")))
    least = digests.groupBy("x", "m").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("x", "m", "least")
    copies = work.keep(digests.join(least, ["x", "m"]).where("id > least").select(F.col("id").alias("copy_id"), "x").distinct())
    small = broadcast_if_small(copies, BROADCAST_IDS)
    is_copy = (F.col("id") == F.col("copy_id")) & (F.xxhash64("text") == F.col("x")) & (F.octet_length("text") >= LENGTH)
    copied = whole.join(small, is_copy, "left_semi").select("id", *(F.octet_length("text").cast("long").alias(c) for c in ("n_bytes", "n_removed")), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    n_docs = whole.select("id").count()
    batches = max(1, -(-n_docs // BATCH_DOCS))
    bits = max(4, int(np.ceil(np.log2(batches * RANGE_BATCHES))))
    dealt = whole.join(small, is_copy, "left_anti").withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("long")).select("batch", "id", "text")
    tuples = work.keep(dealt.groupBy("batch").applyInPandas(_tuples(bits), _SENT).groupBy("range").applyInPandas(_twins, _BITS))
    prefixes = dealt.groupBy("batch").cogroup(tuples.groupBy("batch")).applyInPandas(_prefixes(bits), _SENT)
    earlier = work.keep(prefixes.groupBy("range").applyInPandas(_earlier, _BITS))
    found = tuples.withColumn("tuple", F.lit(True)).union(earlier.withColumn("tuple", F.lit(False)))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    cut = dealt.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(_cut(bits), schema)
    alone = named.where("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.col("text").cast("binary").alias("kept"))
    return cut.union(copied).union(alone).withColumnRenamed("id", id_col)
