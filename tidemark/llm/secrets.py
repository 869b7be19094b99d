"""Secret scans: patterns, and a linear-chain conditional random field that adds what they miss.

Three patterns give the base spans (assign, access, hex). The field tags every token of a text as begin, inside or
outside of a secret, from the token's shape, its neighbours and features of the file, and is decoded by Viterbi. It
learns from the base spans of a bounded sample (SAMPLE_DOCS documents with the least hash of their id; of those that have
WINDOW tokens, windows of so many tokens around their first 20 spans and one drawn anywhere). Spans of the field that
touch no base span and have LEAST_CRF bytes or more are added with kind `crf`; base spans always stay.

Decoding is exact but short: where outside leads by more than all transitions together can make up, a text may be cut
without changing the best path, so only the short stretches between such tokens are decoded.

Null texts count as empty and have no spans. Repeated rows are scanned each for itself. Extra columns are not read. An
empty table gives an empty result; a sample without spans gives a field that tags nothing. Whole texts are read,
however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import least_hashed

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}

SAMPLE_DOCS, WINDOW, STEPS = 6000, 25, 120
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
BATCH_BYTES = 4_000_000
LEAST_CRF = 8
#: Where each group of features begins in the table of weights, and how many there are.
GROUPS = {"shape": 4096, "before": 4096, "after": 4096, "head": 8192, "left_word": 8192, "left_mark": 256, "right_mark": 256, "file": 64}
OFFSETS = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])[:-1].tolist()))
N_FEATURES = sum(GROUPS.values())

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_-"), *range(128, 256)]] = True
_KIND = np.zeros(256, np.uint8)  # 1 lower case, 2 upper case, 4 digit, 8 sign, 16 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 16
_KIND[[*map(ord, "+/_-")]] = 8
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def base_spans(text: str, may_hex: bool = True) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the three patterns; matches that are too short still use up their text."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if may_hex:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _hash(x: np.ndarray, size: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % size


class Batch:
    """Tokens of several texts in one buffer of bytes, with their features."""

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.array([len(c) + 1 for c in coded], np.int64)
        self.low = np.cumsum(self.sizes) - self.sizes
        buf = self.buf = np.frombuffer(b"\n".join(coded) + b"\n" + b"\0" * 8, np.uint8)
        edge = np.diff(_TOKEN[buf].view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.low, self.starts, side="right") - 1
        n, kinds = len(self.starts), _KIND[buf]
        length = self.ends - self.starts
        self.features = np.zeros((n, len(GROUPS)), np.int32)
        if n:
            held = np.bitwise_or.reduceat(kinds, self.starts) if n else kinds[:0]
            # reduceat runs up to the next start; marks between tokens have kind 0 and change nothing
            digits = np.add.reduceat((kinds == 4).view(np.uint8), self.starts, dtype=np.int32)
            turns = np.add.reduceat(np.append(kinds[1:] != kinds[:-1], False).view(np.uint8), self.starts, dtype=np.int32)
            shape = (np.minimum(length // 3, 7) << 9) | (held.astype(np.int64) << 4) | (np.minimum(4 * digits // length, 3) << 2) | np.minimum(4 * turns // (length + 2), 3)
            head = buf[self.starts].astype(np.uint64)
            for k in (1, 2, 3):
                head = head << np.uint64(8) | np.where(length > k, buf[self.starts + k], 0).astype(np.uint64)
            word = np.zeros(n, np.uint64)
            folded = _FOLD[buf]
            for k in range(8):
                word = word * np.uint64(257) + np.where(length > k, folded[self.starts + k], 0).astype(np.uint64)
            word += length.astype(np.uint64) << np.uint64(32)
            first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
            last = np.concatenate([self.doc[1:] != self.doc[:-1], [True]])
            before = np.where(first, 0, np.roll(shape, 1))
            after = np.where(last, 0, np.roll(shape, -1))
            per_doc = np.bincount(self.doc, minlength=len(texts))
            numeric = np.bincount(self.doc, digits > 0, minlength=len(texts))
            file = np.minimum(np.log2(1 + per_doc).astype(np.int64), 15) * 4 + np.minimum((8 * numeric / np.maximum(per_doc, 1)).astype(np.int64), 3)
            columns = (shape, before, after, _hash(head, GROUPS["head"]), np.where(first, 0, _hash(np.roll(word, 1), GROUPS["left_word"])), np.where(self.starts > 0, buf[self.starts - 1], 10), buf[self.ends], file[self.doc])
            for j, (name, c) in enumerate(zip(GROUPS, columns)):
                self.features[:, j] = np.asarray(c, np.int32) + OFFSETS[name]

    def may_hex(self) -> np.ndarray:
        """Which texts hold LEAST["hex"] digits of that kind in a row."""
        edge = np.diff(_HEX[self.buf].view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = starts[ends - starts >= LEAST["hex"]]
        return np.bincount(np.searchsorted(self.low, long, side="right") - 1, minlength=len(self.sizes)) > 0

    def places(self, doc: int) -> np.ndarray:
        """For each byte of a text, the number of code points before it."""
        own = self.buf[self.low[doc] : self.low[doc] + self.sizes[doc]]
        return np.cumsum((own & 0xC0) != 0x80) - 1


class Field:
    """Weights: one row of three per feature, and transitions [from, to]."""

    def __init__(self):
        self.weights = np.zeros((N_FEATURES, 3))
        self.moves = np.zeros((3, 3))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3), np.float32)
        table = self.weights.astype(np.float32)
        for j in range(features.shape[1]):
            out += table[features[:, j]]
        return out

    def train(self, features: np.ndarray, tags: np.ndarray) -> None:
        """features: window, place, group; tags: window, place. Adaptive gradient steps on the mean log-likelihood."""
        n, length = tags.shape
        flat = features.reshape(n * length, -1)
        target = np.eye(3)[tags]
        seen = target[:, :-1].transpose(0, 2, 1) @ target[:, 1:]
        sum_w, sum_m = np.full_like(self.weights, 1e-8), np.full_like(self.moves, 1e-8)
        for _ in range(STEPS):
            e = np.zeros((n * length, 3))
            for j in range(flat.shape[1]):
                e += self.weights[flat[:, j]]
            e = e.reshape(n, length, 3)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for t in range(1, length):
                alpha[:, t] = e[:, t] + np.logaddexp.reduce(alpha[:, t - 1, :, None] + self.moves, 1)
            for t in range(length - 2, -1, -1):
                beta[:, t] = np.logaddexp.reduce(self.moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            z = np.logaddexp.reduce(alpha[:, -1], 1)
            gap = (target - np.exp(alpha + beta - z[:, None, None])).reshape(-1, 3)
            pair = np.exp(alpha[:, :-1, :, None] + self.moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(1)
            grad_w = np.zeros_like(self.weights)
            for s in range(3):
                for j in range(flat.shape[1]):
                    grad_w[:, s] += np.bincount(flat[:, j], gap[:, s], minlength=N_FEATURES)
            grad_w = grad_w / n - 1e-4 * self.weights
            grad_m = (seen - pair).sum(0) / n - 1e-4 * self.moves
            sum_w += grad_w**2
            sum_m += grad_m**2
            self.weights += 0.3 * grad_w / np.sqrt(sum_w)
            self.moves += 0.3 * grad_m / np.sqrt(sum_m)

    def decode(self, emissions: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best tags of every text. Stretches between certain tokens are decoded together, by length."""
        n = len(emissions)
        tags = np.full(n, OUTSIDE, np.int8)
        spread = float(self.moves.max() - self.moves.min())
        certain = emissions[:, OUTSIDE] - np.maximum(emissions[:, BEGIN], emissions[:, INSIDE]) > 2 * spread
        open_ = np.flatnonzero(~certain)
        if not len(open_):
            return tags
        cut = np.concatenate([[True], (np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)])
        starts = open_[cut]
        ends = np.append(open_[np.flatnonzero(cut)[1:] - 1], open_[-1]) + 1
        # a certain neighbour in the same text is outside and joins the stretch by its transition
        has_left = (starts > 0) & (doc[np.maximum(starts - 1, 0)] == doc[starts])
        has_right = (ends < n) & (doc[np.minimum(ends, n - 1)] == doc[starts])
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, ends, has_left, has_right = starts[order], ends[order], has_left[order], has_right[order]
        lengths = ends - starts
        best = emissions[starts] + np.where(has_left[:, None], self.moves[OUTSIDE], 0)
        final, back = best.copy(), []
        for t in range(1, int(lengths.max())):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            through = best[:live, :, None] + self.moves
            back.append(through.argmax(1).astype(np.int8))
            best = through.max(1) + emissions[starts[:live] + t]
            final[:live] = best
        tag = (final + np.where(has_right[:, None], self.moves[:, OUTSIDE], 0)).argmax(1)
        tags[ends - 1] = tag
        for t in range(len(back), 0, -1):
            live = len(back[t - 1])
            tag[:live] = back[t - 1][np.arange(live), tag[:live]]
            tags[starts[:live] + t - 1] = tag[:live]
        return tags


def _tags_of(batch: Batch, texts: list[str]) -> np.ndarray:
    """Tags that the base spans give: the value of a span begins and continues a secret."""
    tags = np.full(len(batch.starts), OUTSIDE, np.int8)
    for i, may in enumerate(batch.may_hex()):
        for start, end, kind in base_spans(texts[i], bool(may)):
            if kind == "assign":
                start = ASSIGN.match(texts[i], start).start(2)
            low = batch.low[i] + len(texts[i][:start].encode("utf-8", "surrogatepass"))
            high = low + end - start  # spans are ASCII
            inside = slice(*np.searchsorted(batch.starts, [low, high]))
            if inside.stop > inside.start:
                tags[inside] = INSIDE
                tags[inside.start] = BEGIN
    return tags


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Learns the field from windows of a bounded sample."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> '' and id is not null")
    chosen = least_hashed(named.select("id"), [], "id", SAMPLE_DOCS).distinct()

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 500):
                texts = frame["text"].iloc[k : k + 500].tolist()
                batch, out = Batch(texts), []
                tags = _tags_of(batch, texts)
                for i, key in enumerate(frame["id"].iloc[k : k + 500].tolist()):
                    low, high = np.searchsorted(batch.doc, [i, i + 1])
                    if high - low < WINDOW:
                        continue
                    hits = np.flatnonzero(tags[low:high] == BEGIN)[:20]
                    rng = np.random.default_rng(key % 2**32)
                    for at in [*np.clip(hits - WINDOW // 2, 0, high - low - WINDOW).tolist(), int(rng.integers(high - low - WINDOW + 1))]:
                        w = slice(low + at, low + at + WINDOW)
                        out.append((key, batch.features[w].astype(np.int32).tobytes(), tags[w].tobytes()))
                yield pd.DataFrame(out, columns=["id", "features", "tags"])

    got = sorted(named.join(F.broadcast(chosen), "id").mapInPandas(rows, "id long, features binary, tags binary").collect())  # at most 21 windows for each sampled document
    field = Field()
    if got:
        features = np.array([np.frombuffer(r[1], np.int32) for r in got]).reshape(len(got), WINDOW, len(GROUPS))
        tags = np.array([np.frombuffer(r[2], np.int8) for r in got]).reshape(len(got), WINDOW)
        if (tags == BEGIN).any():
            field.train(features, tags.astype(np.int64))
        else:
            field.weights[: GROUPS["shape"], OUTSIDE] = 1
    else:
        field.weights[: GROUPS["shape"], OUTSIDE] = 1
    return field


def scan(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: spans, an array of (kind, start, end) by start, in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = "id long, spans array<struct<kind:string,start:int,end:int>>"

    def part(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        batch = Batch(texts)
        may = batch.may_hex()
        spans = [base_spans(t, bool(m)) for t, m in zip(texts, may)]
        tags = shared.value.decode(shared.value.emissions(batch.features), batch.doc)
        secret = np.flatnonzero(tags != OUTSIDE)
        if len(secret):
            cut = np.concatenate([[True], (np.diff(secret) > 1) | (tags[secret[1:]] == BEGIN) | (batch.doc[secret[1:]] != batch.doc[secret[:-1]])])
            heads = secret[cut]
            tails = np.append(secret[np.flatnonzero(cut)[1:] - 1], secret[-1])
            place, at = None, -1
            for h, t in zip(heads.tolist(), tails.tolist()):
                i = int(batch.doc[h])
                if batch.ends[t] - batch.starts[h] < LEAST_CRF:
                    continue
                if i != at:
                    place, at, base = batch.places(i), i, list(spans[i])
                start, end = int(place[batch.starts[h] - batch.low[i]]), int(place[batch.ends[t] - batch.low[i]])
                if all(end <= s or e <= start for s, e, _ in base):
                    spans[i].append((start, end, "crf"))
        rank = (*KINDS, "crf").index
        return [[(k, s, e) for s, e, k in sorted(x, key=lambda y: (y[0], rank(y[2])))] for x in spans]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, low, out = [t or "" for t in frame["text"]], 0, []
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (size < BATCH_BYTES or high == low):
                    size += len(texts[high])
                    high += 1
                out += part(texts[low:high])
                low = high
            yield pd.DataFrame({"id": frame["id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in out]})

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInPandas(rows, schema).withColumnRenamed("id", id_col)


def find_secrets(docs: DataFrame, **columns: str) -> DataFrame:
    return scan(docs, fit(docs, **columns), **columns)
