"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is counted as pairs of adjacent byte classes (letters by case, digits, blanks, line ends, kinds of punctuation,
bytes of other letters) plus terms for how often its passages and adjacent words repeat. Counts are damped, weighted by inverse document
frequency over all documents and projected on the leading singular vectors of a bounded labelled sample. Every document
is compared with every vector of that sample (exact cosines, in blocks); the NEIGHBOURS nearest vote with their
labels, weighted by similarity.

The sample: the PER_LABEL labelled documents of each label with the least hash of their id; rows that are held out are
never used. Score: weighted share of label 1 (labels above 0 count as 1). Texts that are null or empty, or all texts if
nothing was learnt, get the share of label 1 among the rows learnt from (0.5 without any); so do texts of one byte, which
have no terms. Repeated rows are scored each for itself; repeated labels of one id count once, by the larger label. Of
neighbours that are equally near at the last place any may vote. Extra columns are kept; columns named quality_score or
quality_predicted are replaced. An empty table gives an empty result. Whole texts are read, however long.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import held_out, least_hashed

PER_LABEL, NEIGHBOURS, DIMENSIONS, BLOCK_DOCS = 1500, 15, 64, 1024
CLASSES, REPEAT_TERMS, TWICE_TERMS = 64, 16, 8
TERMS = CLASSES * CLASSES + REPEAT_TERMS + TWICE_TERMS
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    out = np.full(256, 63, np.uint16)
    out[128:] = 58 + (np.arange(128, 256) >> 5 & 3)
    for i in range(26):
        out[97 + i], out[65 + i] = i, 26 + i
    for chars, k in (("0123456789", 52), (" \t", 53), ("\n\r", 54), (".,;:'\"-", 55), ("!?", 56), ("|<>{}[]()/\\=_+~^`", 57), ("#$%&*@", 62)):
        for c in chars:
            out[ord(c)] = k
    return out


_CLASS = _classes()


def count_terms(text: str | None) -> np.ndarray:
    """Numbers of all terms in a whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(TERMS, np.float32)
    if len(raw) < 2:
        return out
    c = _CLASS[raw]
    out[: CLASSES * CLASSES] = np.bincount(c[:-1] * np.uint16(CLASSES) + c[1:], minlength=CLASSES * CLASSES)
    if len(raw) >= 16:  # how many of the eight-byte passages are new, in sixteenths
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()
        out[CLASSES * CLASSES + min(REPEAT_TERMS - 1, int(REPEAT_TERMS * len(np.unique(keys)) / len(keys)))] = len(raw) / 4
    words = text.split()
    if len(words) >= 4:  # how many words only repeat the one before, in eighths
        twice = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
        out[TERMS - TWICE_TERMS + min(TWICE_TERMS - 1, TWICE_TERMS * twice // len(words))] = len(raw) / 4
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents, and in how many each term occurs: counted in each partition, then summed."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(TERMS, np.int64), 0
        for frame in frames:
            n += len(frame)
            for text in frame["text"]:
                df += count_terms(text) > 0
        yield pd.DataFrame({"term": np.append(np.flatnonzero(df), -1), "n": np.append(df[df > 0], n)})

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(rows, "term int, n long").groupBy("term").agg(F.sum("n")).collect()  # TERMS rows at most
    out, n = np.zeros(TERMS, np.int64), 0
    for term, count in counted:
        if term < 0:
            n = count
        else:
            out[term] = count
    return n, out


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, prior: float, n_docs: int, df: np.ndarray):
        self.prior = prior
        self.idf = np.log((1 + n_docs) / (1 + df)).astype(np.float32) + np.float32(0.2)
        self.labels = labels.astype(np.float32)
        self.axes = np.zeros((TERMS, 0), np.float32)
        if len(counts):
            m = self.weigh(counts, counts)
            rng = np.random.default_rng(7)
            q = rng.standard_normal((TERMS, min(DIMENSIONS + 16, len(m)))).astype(np.float32)
            for _ in range(4):  # subspace iteration
                q, _ = np.linalg.qr(m.T @ (m @ q))
            _, _, vt = np.linalg.svd(m @ q, full_matrices=False)
            self.axes = np.ascontiguousarray((q @ vt.T)[:, :DIMENSIONS])
            self.vectors = self._turned(m)

    def weigh(self, counts: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Damped and weighted counts of length one; in the place of out, if that is given."""
        m = np.log1p(counts, out=out)
        m *= self.idf
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return m

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return self._turned(self.weigh(counts))

    def _turned(self, m: np.ndarray) -> np.ndarray:
        v = m @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        cosine = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, 1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 8
        total = weight.sum(1)
        some = total > 0
        out[some] = ((weight * self.labels[near]).sum(1)[some] / total[some]).clip(0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    n_docs, df = document_frequencies(docs, text_col)
    marked = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).where(F.col("label").isNotNull() & ~F.coalesce(held_out("id"), F.lit(True)))
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    totals = dict(marked.groupBy("label").count().collect())
    chosen = least_hashed(marked, ["label"], "id", PER_LABEL).select("id", "label")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counted = [count_terms(t).astype(np.uint16 if len(t) < 65_536 else np.float32).astype(np.float32) for t in frame["text"]]
            there = [np.flatnonzero(c) for c in counted]
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "terms": [t.astype(np.uint16).tobytes() for t in there], "counts": [c[t].tobytes() for c, t in zip(counted, there)]})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''").join(F.broadcast(chosen), "id")
    got = sorted(texts.mapInPandas(rows, "id long, label int, terms binary, counts binary").collect())  # 2 * PER_LABEL rows, but for repeated ids
    counts = np.zeros((len(got), TERMS), np.float32)
    for row, r in zip(counts, got):
        row[np.frombuffer(r[2], np.uint16)] = np.frombuffer(r[3], np.float32)
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    return Model(counts, np.array([r[1] for r in got]), prior, n_docs, df)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, and quality_score (double) and quality_predicted (int)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        parts = [shared.value.score(np.array([count_terms(t) for t in texts[k : k + BLOCK_DOCS]])) for k in range(0, len(texts), BLOCK_DOCS)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("quality_score", scored(F.col(text_col).cast("string"))).withColumn("quality_predicted", (F.col("quality_score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fits on labels and scores docs."""
    return score(docs, fit(docs, labels, **options), **{k: v for k, v in options.items() if k != "label_col"})
