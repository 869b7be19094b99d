"""Language identification by cross-parsing entropy.

For each language the labelled text of a bounded sample becomes a suffix automaton. A text is parsed, against each
automaton, into phrases that are each the longest match with anything in that language's text; fewer phrases per
character mean less surprise, and the language with the fewest wins (ties: the first by name).

Many places are parsed at once: a text is cut into blocks, and each is parsed as if a phrase began with it. Then every
block is parsed again from where its predecessor ended, until a phrase begins where one began before: from there on both
are the same, so the number of phrases is that of one parse of the whole text. A block in which this never happens hands
its new end on to the next one.

The sample: per language the SAMPLE_DOCS labelled documents with the least hash of their id, as whole texts (its size in
the driver is bounded by their number and the longest text). Letters are compared in lower case, each letter of the
sample as itself, all other letters as one; all else counts as a blank.

Null texts and texts without a letter give `und` with score 0; so do all texts if nothing was learnt. Repeated rows are
predicted each for itself; of repeated rows of one id and language the first text by order is learnt from. Extra columns
are not read. An empty table gives an empty result. Very long texts are blocks like any others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, least_hashed

SAMPLE_DOCS = 24
BLOCK, BATCH_CHARS, BATCH_BLOCKS = 512, 4_000_000, 8192
BLANK, UNKNOWN = 0, 1


def _letter(c: str) -> int:
    """The code point of a letter's lower case; 0 for anything else."""
    return 0 if not c.isalpha() else ord(low) if len(low := c.lower()) == 1 else ord(c)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([_letter(chr(i)) for i in range(0x10000)], np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lowered(points: np.ndarray) -> np.ndarray:
    """Lower-case letters; 0 for anything else."""
    basic = points < 0x10000
    out = _letters()[np.where(basic, points, 0)]
    if not basic.all():
        out[~basic] = [_letter(chr(p)) for p in points[~basic].tolist()]
    return out


def squeeze(classes: np.ndarray) -> np.ndarray:
    """Each run of blanks becomes one."""
    keep = np.ones(len(classes), bool)
    keep[1:] = (classes[1:] != BLANK) | (classes[:-1] != BLANK)
    return classes[keep]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of a sequence of classes: for each state its transitions. State 0 is the root."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return following


def packed(following: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions in one array: that of state s by class c is at base[s] + c, if owner says that the place is that of s.

    States with several transitions take the first gap that all fit into, those with one fill what is left.
    """
    base = [0] * len(following)
    used = bytearray(width + 2 * sum(map(len, following)) + 2 * width)
    low = 0
    for state in sorted((s for s, t in enumerate(following) if len(t) > 1), key=lambda s: -len(following[s])):
        classes = list(following[state])
        at, tries = low, 0
        while any(used[at + c] for c in classes):
            at += 1
            tries += 1
            if at + width >= len(used):
                used.extend(bytes(len(used)))
        if tries > 16:
            low += tries // 8
        base[state] = at
        for c in classes:
            used[at + c] = 1
    free = width  # a base may not be negative
    for state, t in enumerate(following):
        for c in t if len(t) == 1 else ():
            while used[free]:
                free += 1
                if free + width >= len(used):
                    used.extend(bytes(len(used)))
            used[free] = 1
            base[state] = free - c
    size = len(used) + width
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for state, t in enumerate(following):
        for c, target in t.items():
            owner[base[state] + c], to[base[state] + c] = state, target
    return np.array(base, np.int32), owner, to


class Model:
    """The automata of all languages, one after the other in the same arrays."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        lowered = {k: np.concatenate([np.zeros(0, np.int64), *(np.append(_lowered(code_points(t)), 0) for t in v)]) for k, v in texts.items()}
        known = np.unique(np.concatenate([np.zeros(1, np.int64), *lowered.values()]))[1:]
        self.classes = np.full(0x110000, UNKNOWN, np.int32)
        self.classes[0] = BLANK
        self.classes[known] = np.arange(2, len(known) + 2)
        width = len(known) + 2
        parts, self.roots, states, places = [], [], 0, 0
        self.first = np.zeros((len(self.languages), width), np.int32)
        for i, k in enumerate(self.languages):
            following = automaton(squeeze(self.classes[lowered[k]]))
            base, owner, to = packed(following, width)
            self.first[i] = states
            for c, target in following[0].items():
                self.first[i, c] = target + states
            self.roots.append(states)
            parts.append((base + places, np.where(owner < 0, -1, owner + states), to + states))
            states += len(base)
            places += len(owner)
        self.base, self.owner, self.to = (np.concatenate(x).astype(np.int32) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 3

    def _step(self, language: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins."""
        at = self.base[state] + c
        begins = self.owner[at] != state
        return np.where(begins, self.first[language, c], self.to[at]), begins

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray, follows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """blocks: classes by (block, place), of which lengths are in use. follows: whether a block goes on with the text of
        the one before it; before: the states by language ahead of the first block. Gives the number of phrases by
        (language, block), and the states at the end of the last block."""
        columns = np.ascontiguousarray(blocks.T)
        n, languages = len(blocks), np.arange(len(self.languages))[:, None]
        begun = np.zeros((BLOCK, len(languages), n), bool)
        state = np.zeros((len(languages), n), np.int32)
        for j in range(int(lengths.max())):
            live = lengths > j
            moved, begins = self._step(languages, state, columns[j][None]) if j else (self.first[languages, columns[0][None]], np.ones(state.shape, bool))
            state = np.where(live, moved, state)
            begun[j] = begins & live
        count = begun.sum(0, dtype=np.int64)
        end, own_end = state.copy(), state
        redo = np.broadcast_to(follows, state.shape).copy()
        while redo.any():
            lang, block = np.nonzero(redo)
            at = np.where(block > 0, end[lang, block - 1], before[lang])
            found, passed = np.zeros(len(lang), np.int64), np.zeros(len(lang), np.int64)
            redo = np.zeros_like(redo)
            live = np.arange(len(lang))
            for j in range(BLOCK):
                short = live[lengths[block[live]] <= j]
                live = live[lengths[block[live]] > j]
                self._close(short, lang, block, at, found, count, end, redo, follows)
                if not len(live):
                    break
                at[live], begins = self._step(lang[live], at[live], columns[j][block[live]])
                met = begun[j][lang[live], block[live]]
                same = live[begins & met]
                if len(same):  # from here on as in the first parse
                    count[lang[same], block[same]] = found[same] + begun[:, lang[same], block[same]].sum(0) - passed[same]
                    self._end(same, lang, block, own_end[lang[same], block[same]], end, redo, follows)
                found[live] += begins
                passed[live] += met
                live = live[~(begins & met)]
            self._close(live, lang, block, at, found, count, end, redo, follows)
        return count, end[:, -1]

    def _close(self, some, lang, block, at, found, count, end, redo, follows) -> None:
        """Blocks that never met their first parse: all their phrases, and their end, are new."""
        if len(some):
            count[lang[some], block[some]] = found[some]
            self._end(some, lang, block, at[some], end, redo, follows)

    @staticmethod
    def _end(some, lang, block, to, end, redo, follows) -> None:
        changed = end[lang[some], block[some]] != to
        end[lang[some], block[some]] = to
        onward = changed & (block[some] + 1 < len(follows))
        onward[onward] = follows[block[some][onward] + 1]
        redo[lang[some][onward], block[some][onward] + 1] = True

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per character by (language, text), and whether a text has a letter."""
        parts, letters = [], np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            low = _lowered(code_points(t or ""))
            letters[i] = low.any()
            parts.append(squeeze(self.classes[low]))
        lengths = np.array([len(p) for p in parts], np.int64)
        n_blocks = -(-lengths // BLOCK)
        total, first = int(n_blocks.sum()), np.cumsum(n_blocks) - n_blocks
        flat = np.concatenate([np.zeros(0, np.int32), *parts])
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        within = np.arange(total) - first[owner]
        starts = (np.cumsum(lengths) - lengths)[owner] + within * BLOCK
        used = np.minimum(BLOCK, lengths[owner] - within * BLOCK)
        out = np.full((len(self.languages), len(texts)), np.inf)
        if total and self.languages:
            count, before = [], np.zeros(len(self.languages), np.int32)
            for low in range(0, total, BATCH_BLOCKS):
                some = slice(low, low + BATCH_BLOCKS)
                places = starts[some][:, None] + np.arange(BLOCK)
                inside = np.arange(BLOCK) < used[some][:, None]
                blocks = np.where(inside, flat[np.minimum(places, len(flat) - 1)], BLANK)
                part, before = self.phrases(blocks, used[some], within[some] > 0, before)
                count.append(part)
            some = n_blocks > 0
            out[:, some] = np.add.reduceat(np.concatenate(count, 1), first[some], 1) / lengths[some]
        return out, letters


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows that are not held out and have text and a language; the driver sees the bounded sample only."""
    text = F.col(text_col).cast("string")
    known = docs.where(~F.coalesce(held_out(id_col), F.lit(True)) & F.col(lang_col).isNotNull() & text.isNotNull())
    named = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("language"), text.alias("text"))
    chosen = least_hashed(named.select("id", "language"), ["language"], "id", SAMPLE_DOCS).select("id", "language").distinct()
    rows = named.join(F.broadcast(chosen), ["id", "language"]).groupBy("language", "id").agg(F.min("text").alias("text")).collect()  # SAMPLE_DOCS texts of each language
    texts: dict[str, list[str]] = {}
    for language, _, t in sorted(rows):
        texts.setdefault(language, []).append(t)
    return Model(texts)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: held_out, lang_pred, score (the runner-up's share of phrases among the best two; 0 for und)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for frame in frames:
            texts, low = frame["text"].tolist(), 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (size < BATCH_CHARS or high == low):
                    size += len(texts[high] or "")
                    high += 1
                density, letters = own.score(texts[low:high])
                part = frame[["id", "held_out"]].iloc[low:high]
                if own.languages:
                    best = density.argmin(0)
                    ranked = np.sort(density, 0)
                    score = ranked[1] / (ranked[0] + ranked[1]) if len(ranked) > 1 else np.ones(len(best))
                    yield part.assign(lang_pred=names[np.where(letters, best, len(own.languages))], score=np.where(letters, score, 0.0))
                else:
                    yield part.assign(lang_pred="und", score=0.0)
                low = high

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return named.mapInPandas(rows, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, **columns: str) -> DataFrame:
    return predict(docs, fit(docs, **columns), **{k: v for k, v in columns.items() if k != "lang_col"})
