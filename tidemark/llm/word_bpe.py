"""BPE with word ends by tree concatenation: halves are encoded apart and re-encoded only around their joins.

A text is split by the tokenizer's rules into pieces, which merges never cross. A piece of more than LEAF symbols is cut
into halves, these again, down to leaves; leaves are encoded by merging the leftmost pair of least rank. Two encoded
halves become one by re-encoding a window around their join: one token of each side at first, twice as many of a side
whenever the window's outermost token there is not the one that the half had. Once both agree, every two neighbours of
the result are what their own text encodes to, which makes the whole the encoding of the whole text.

The tree's upper levels are Spark's: a piece of more than SPREAD symbols is cut into rows of its own, dealt over the
cluster, encoded there, and joined again where its document is put together. So one huge piece (a text without a blank or
a change of kind) is no task's work alone.

Null texts count as empty. Empty texts give no ids. Special tokens inside of a text are found as such, as the tokenizers
library does by default. A code point that this Python's Unicode tables don't know is left to the library's own
normaliser and splitter. Rows of a repeated id are encoded each for itself; other columns don't matter, whatever their
names. An empty table gives an empty result. Tokenizer files are read, never trained.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import WorkTables

#: Pieces of up to so many symbols are merged as they are.
LEAF = 16
#: More than any rank.
_NONE = 1 << 62
#: Longer pieces than this are rows of their own; so long are these rows at most.
SPREAD = 4096
#: A worker forgets its runs and pieces beyond so many, so that memory stays bounded.
CACHE_PIECES = 600_000
#: The codec of this Python worker, kept from task to task.
_CODECS: dict = {}


def read_tokenizer(path: str) -> bytes:
    """The content of a tokenizer file, read by the driver; vocabularies are bounded (some MB)."""
    with open(path, "rb") as file:
        return file.read()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the file: printable ones for themselves, the others numbered from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class LongPiece(Exception):
    """A piece has more than SPREAD symbols."""


class _Known(dict):
    """What runs between blanks become; a run not yet known is learnt."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, run: str) -> str:
        self.learn(run)
        return self[run]


class Codec:
    """Encodes and decodes by one tokenizer file: NFC, lower case, a splitting pattern, BPE whose last symbol carries a suffix."""

    def __init__(self, file: bytes):
        whole = json.loads(file)
        model = whole["model"]
        self.vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.token_of = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.token_of |= {i: t for t, i in self.special.items()}
        letters = _byte_letters()
        self.inner = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + end] for b in range(256)]
        base = {self.token_of[i]: i for i in self.inner + self.last}
        #: The symbols that a token is made of.
        self.parts = {i: self._symbols(t, end, base) for t, i in self.vocab.items()}
        if max(self.token_of) >= 1 << 20:
            raise ValueError("ids of more than 20 bits")
        #: Left id and right id -> rank and id of the joined token, each pair in one number, ids in the lower 20 bits.
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: rank << 20 | self.vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        split = next(p for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces_of = regex.compile(split["pattern"]["Regex"]).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda text: [text]
        self.letters = {c: b for b, c in letters.items()}
        self.file, self.library, self.known, self.cache = file, None, {}, {}
        #: Ids (decimal) and tokens of runs between blanks, joined by blanks.
        self.run_ids, self.run_tokens = _Known(self._learn), _Known(self._learn)

    @staticmethod
    def _symbols(token: str, end: str, base: dict[str, int]) -> tuple[int, ...]:
        if not token.endswith(end) or token == end:
            return tuple(base[c] for c in token)
        body = token[: -len(end)]
        return (*(base[c] for c in body[:-1]), base[body[-1] + end])

    def split(self, text: str) -> list[str | int]:
        """The pieces of a text (as text) and its special tokens (as ids), in order."""
        out: list[str | int] = []
        for part in self._parts(text):
            out += [part] if isinstance(part, int) else part if isinstance(part, list) else self.pieces_of(part)
        return out

    def _parts(self, text: str) -> list[str | int | list[str]]:
        """Special tokens (as ids) and what is between them: normalised text, or pieces where the library has split it."""
        if not self.special or "<" not in text:
            return [self._plain(text)]
        return [self.special[part] if part in self.special else self._plain(part) for part in self.at_special(text)]

    def _plain(self, text: str) -> str | list[str]:
        if text.isascii():
            return text.lower()
        for c in set(text):
            if c not in self.known:
                self.known[c] = unicodedata.category(c) != "Cn"
            if not self.known[c]:
                return self._by_library(text)
        text = unicodedata.normalize("NFC", text)
        # A capital sigma is lower-cased by itself here, not by where it stands.
        return "σ".join(part.lower() for part in text.split("Σ"))

    def coded(self, text: str) -> tuple[str, str]:
        """Ids (decimal) and tokens of a text, each joined by blanks. Raises LongPiece.

        No piece holds a blank or goes on behind one, so every run between blanks is coded by itself, and once.
        """
        if len(self.run_ids) > CACHE_PIECES:
            self.run_ids.clear()
            self.run_tokens.clear()
        ids, tokens = [], []
        for part in self._parts(text):
            if isinstance(part, str):
                runs = part.replace("\n", " ").split(" ")
                ids.append(" ".join(filter(None, map(self.run_ids.__getitem__, runs))))
                tokens.append(" ".join(filter(None, map(self.run_tokens.__getitem__, runs))))
            else:
                found = [*map(self._short, [part] if isinstance(part, int) else part)]
                ids.append(" ".join([f[1] for f in found]))
                tokens.append(" ".join([f[2] for f in found]))
        return " ".join(filter(None, ids)), " ".join(filter(None, tokens))

    def _short(self, piece: str | int) -> tuple[int, str, str]:
        if isinstance(piece, str) and is_long(piece):
            raise LongPiece
        return self.piece(piece)

    def _learn(self, run: str) -> None:
        found = [*map(self._short, self.pieces_of(run))]
        self.run_ids[run] = " ".join([f[1] for f in found])
        self.run_tokens[run] = " ".join([f[2] for f in found])

    def _by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file.decode())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.letters[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in found]

    def symbols(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogateescape")
        return [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]

    def merge(self, ids: list[int]) -> list[int]:
        """Merges the leftmost pair of least rank until none is left."""
        if len(ids) > 4 * LEAF:
            return self._merge_long(ids)
        ids, get = list(ids), self.merges.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges from a heap of (rank and id, place), for windows that had to grow."""
        ids, n, get = list(ids), len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = lambda i: get(ids[i] << 20 | ids[after[i]]) if after[i] < n else None
        heap = [(m, i) for i in range(n - 1) if (m := at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            if ids[i] is None or at(i) != m:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = m & 0xFFFFF, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (m := at(k)) is not None:
                    heapq.heappush(heap, (m, k))
        return [i for i in ids if i is not None]

    def encode(self, symbols: list[int]) -> list[int]:
        """The ids of a run of symbols, by halves."""
        if len(symbols) <= LEAF:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.encode(symbols[:half]), self.encode(symbols[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two encoded neighbours as one text: windows around the join grow until both sides agree."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            outer = left[len(left) - a :], right[:b]
            window = self.merge([s for side in outer for token in side for s in self.parts[token]])
            agree_left, agree_right = a == len(left) or window[0] == outer[0][0], b == len(right) or window[-1] == outer[1][-1]
            if agree_left and agree_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if agree_left else 2 * a, b if agree_right else 2 * b

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Encoded neighbours as one text: level by level, two at a time."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def piece(self, piece: str | int) -> tuple[int, str, str]:
        """How many ids a piece has, these in decimal and their tokens, both joined by blanks."""
        found = self.cache.get(piece)
        if found is None:
            ids = [piece] if isinstance(piece, int) else self.encode(self.symbols(piece))
            found = len(ids), " ".join(map(str, ids)), " ".join(map(self.token_of.__getitem__, ids))
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def ids_of(self, piece: str | int) -> list[int]:
        return [int(i) for i in self.piece(piece)[1].split()]


def is_long(piece: str) -> bool:
    return 4 * len(piece) > SPREAD and len(piece.encode("utf-8", "surrogateescape")) > SPREAD


def _codec(file: bytes) -> Codec:
    key = hashlib.sha256(file).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(file)
    return _CODECS[key]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def _split_rows(file, with_ids: bool):
    """Whole rows for documents without a piece of more than SPREAD symbols; of all others the runs between such pieces,
    encoded (ids), and these pieces in rows (symbols), numbered by seg and part."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, task, made = _codec(file.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"]):
                try:
                    ids, tokens = codec.coded(text) if isinstance(text, str) else ("", "")
                    out.append((key, None, None, None, None, ids.count(" ") + (ids != ""), _sha(ids), _sha(tokens), np.array(ids.split(), np.int32) if with_ids else None))
                    continue
                except LongPiece:
                    pieces = codec.split(text)
                    long = [i for i, p in enumerate(pieces) if isinstance(p, str) and is_long(p)]
                made, low = made + 1, 0
                uid = f"{task}-{made}"
                for seg, i in enumerate([*long, len(pieces)]):
                    between = [x for p in pieces[low:i] for x in codec.ids_of(p)]
                    out.append((key, uid, 2 * seg, 0, None, None, None, None, np.array(between, np.int32)))
                    if i < len(pieces):
                        symbols = np.array(codec.symbols(pieces[i]), np.int32)
                        parts = np.array_split(symbols, 1 << (-(-len(symbols) // SPREAD) - 1).bit_length())
                        out += [(key, uid, 2 * seg + 1, n, part, None, None, None, None) for n, part in enumerate(parts)]
                    low = i + 1
            yield pd.DataFrame(out, columns=["id", "uid", "seg", "part", "symbols", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return rows


def encode_decode(docs: DataFrame, tokenizer: bytes, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes the ids again: n_tokens, digests of the ids (joined by one blank) and of the decoded
    text; with_ids adds the ids (array of int)."""
    spark = docs.sparkSession
    work, file = WorkTables(spark, "word_bpe"), spark.sparkContext.broadcast(tokenizer)
    columns = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = work.keep(texts.mapInPandas(_split_rows(file, with_ids), f"id long, uid string, seg int, part int, symbols array<int>, {_DIGESTS}"))
    done, parted = kept.where("uid is null").select(*columns), kept.where("uid is not null")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(file.value)
        for batch in batches:
            batch["ids"] = [np.array(codec.encode(s.tolist()), np.int32) for s in batch["symbols"]]
            yield batch[["id", "uid", "seg", "part", "ids"]]

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(file.value)
        ids = [x for _, seg in group.sort_values(["seg", "part"]).groupby("seg") for x in codec.join_all([p.tolist() for p in seg["ids"]])]
        row = group["id"].iloc[0], len(ids), _sha(" ".join(map(str, ids))), _sha(" ".join(map(codec.token_of.__getitem__, ids))), np.array(ids, np.int32)
        return pd.DataFrame([row], columns=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    if parted.limit(1).count():
        leaves = parted.where("symbols is not null").repartition("uid", "seg", "part")
        leaves = leaves.select("id", "uid", "seg", "part", "symbols").mapInPandas(encoded, "id long, uid string, seg int, part int, ids array<int>")
        segments = parted.where("symbols is null").select("id", "uid", "seg", "part", "ids").unionByName(leaves)
        done = done.unionByName(segments.groupBy("uid").applyInPandas(whole, f"id long, {_DIGESTS}").select(*columns))
    return done.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer: bytes, *, ids_col: str = "ids") -> DataFrame:
    """All columns of rows, and decoded: the tokens of an array of ids, joined by blanks. Null ids give null; an id that the
    file does not have fails the job. A column named decoded is replaced."""
    file = rows.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf(StringType())
    def decoded(ids: pd.Series) -> pd.Series:
        tokens = _codec(file.value).token_of
        return ids.map(lambda x: None if x is None else " ".join(tokens[i] for i in x))

    return rows.withColumn("decoded", decoded(F.col(ids_col).cast("array<int>")))
