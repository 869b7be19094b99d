"""Byte-level BPE encoding and decoding in numpy matrices.

A text is split by a pattern; each distinct piece of a batch is encoded once. Pieces are grouped by length into padded
matrices of token ids. In each round every row merges its leftmost pair of least rank, found in a hash table of pairs,
and closes the gap. Pieces too long for a matrix are merged in the same order with a heap, so that one huge piece costs
n log n. Rank files are read, never trained.

Null texts count as empty. Empty texts give no ids. Repeated rows are encoded each for itself; other columns do not
matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_NONE = np.int32(2**31 - 1)
#: Above this length in bytes a piece goes to the heap.
MATRIX_BYTES = 256
#: A worker forgets its pieces beyond so many, so that memory stays bounded.
CACHE_PIECES = 500_000
#: The codec of this Python worker, kept from task to task.
_CODECS: dict = {}


def read_ranks(spark, path: str) -> bytes:
    """The content of a rank file, read by the driver; vocabularies are bounded (some MB)."""
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """Encodes and decodes with one rank file and one pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        if not all(bytes([b]) in self.ranks for b in range(256)) or max(self.tokens) >= 2**31 - 1:
            raise ValueError("the rank file must hold all single bytes")
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self._build_pairs()
        self.ids_of: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {}

    def _build_pairs(self) -> None:
        """An open-addressing table: key (left id, right id), value the rank of the joined token."""
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        slot, self.probes = self._slot(keys), 1
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += len(keys) > 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined pairs, _NONE where there is no such token or an id is padding."""
        keys = (left << 32 | right).ravel()
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        slot = self._slot(keys[todo])
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out.reshape(left.shape)

    def encode_matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of similar length, one piece after the other, and how many each piece has."""
        width = max(map(len, pieces))
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        done = np.full((len(pieces), width), -1, np.int64)
        rows = np.arange(len(pieces))
        ranks = self.rank_of_pairs(ids[:, :-1], ids[:, 1:])
        while len(rows) and ids.shape[1] > 1:
            at = ranks.argmin(1)  # the first of equal ranks
            best = ranks[np.arange(len(rows)), at]
            over = best == _NONE
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                on = ~over
                rows, ids, ranks, at, best = rows[on], ids[on], ranks[on], at[on], best[on]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = best
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            if ids.shape[1] == 1:
                break
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            for next_to in (at - 1, at):
                ok = np.flatnonzero((next_to >= 0) & (next_to < ranks.shape[1]))
                j = next_to[ok]
                ranks[ok, j] = self.rank_of_pairs(ids[ok, j], ids[ok, j + 1])
        done[rows, : ids.shape[1]] = ids
        return done[done >= 0], (done >= 0).sum(1)

    def encode_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, by a heap of (rank, place)."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        tokens = [bytes([b]) for b in piece]
        rank = lambda i: self.ranks.get(tokens[i] + tokens[after[i]]) if after[i] < len(ids) else None
        heap = [(r, i) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if tokens[i] is None or rank(i) != r:
                continue
            j = after[i]
            tokens[i], tokens[j], ids[i] = tokens[i] + tokens[j], None, r
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x, t in zip(ids, tokens) if t is not None]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes pieces not yet known, in matrices of like lengths."""
        new = list(set(pieces) - self.ids_of.keys())
        coded = [p.encode("utf-8", "surrogatepass") for p in new]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(sizes, kind="stable")
        sizes, low = sizes[order], 0
        while low < len(order):
            n = int(sizes[low])
            if n > MATRIX_BYTES:
                high = low + 1
                ids = self.encode_long(coded[order[low]])
                counts = [len(ids)]
            else:
                top = next(x for x in (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, MATRIX_BYTES) if x >= n)
                high = min(int(np.searchsorted(sizes, top, side="right")), low + max(1, 2_000_000 // top))
                ids, counts = self.encode_matrix([coded[i] for i in order[low:high]])
                ids, counts = ids.tolist(), counts.tolist()
            decimal, tokens, at = [*map(self.decimal.__getitem__, ids)], [*map(self.tokens.__getitem__, ids)], 0
            for i, n in zip(order[low:high].tolist(), counts):
                self.ids_of[new[i]] = ",".join(decimal[at : at + n])
                self.bytes_of[new[i]] = b"".join(tokens[at : at + n])
                at += n
            low = high

    def encode(self, text: str) -> tuple[list[str], str]:
        """The pieces of a text and its ids in decimal, joined by commas."""
        pieces = self.split(text)
        if len(self.ids_of) > CACHE_PIECES:
            self.ids_of, self.bytes_of = {}, {}
        try:
            return pieces, ",".join(map(self.ids_of.__getitem__, pieces))
        except KeyError:
            self.learn(pieces)
            return pieces, ",".join(map(self.ids_of.__getitem__, pieces))

    def decode(self, pieces: list[str]) -> bytes:
        """The bytes of the ids of these pieces: each id's token, joined."""
        return b"".join(map(self.bytes_of.__getitem__, pieces))


def _codec(rank_file: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, rank_file: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes the ids again: n_tokens and digests of ids and decoded bytes; with_ids adds the ids (array of int)."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            out = []
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            low = 0
            while low < len(texts):  # pieces of about 2 MB of text are learnt together
                high, chars = low, 0
                while high < len(texts) and (chars < 2_000_000 or high == low):
                    chars += len(texts[high])
                    high += 1
                if len(codec.ids_of) > CACHE_PIECES:
                    codec.ids_of, codec.bytes_of = {}, {}
                split = [codec.split(t) for t in texts[low:high]]
                codec.learn(set().union(*split))
                for key, pieces in zip(batch["id"][low:high], split):
                    ids = ",".join(map(codec.ids_of.__getitem__, pieces))
                    row = (key, ids.count(",") + (len(pieces) > 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(codec.decode(pieces)).hexdigest())
                    out.append(row + ([int(x) for x in ids.split(",") if x],) if with_ids else row)
                low = high
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    coded = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(rows, schema)
    return coded.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, rank_file: bytes, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """All columns of rows, and decoded (binary): the bytes of an array of ids. Null ids give null; an id that the rank file
    does not have fails the job. A column named decoded is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(rank_file)

    @F.pandas_udf(BinaryType())
    def decoded(ids: pd.Series) -> pd.Series:
        tokens = _codec(shared.value, pattern).tokens
        return ids.map(lambda x: None if x is None else b"".join(tokens[i] for i in x))

    return rows.withColumn("decoded", decoded(F.col(ids_col).cast("array<int>")))
