"""Text functions in native expressions: pages, paragraphs, markers, n-grams, hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import broadcast_if_small, kept


def page_text(c: Column) -> Column:
    """Markdown links become their text, citation marks go, quotes are unified, white space is one blank, lower case."""
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)", "$1")
    c = F.regexp_replace(c, r"\[\d+\]", "")
    c = F.translate(c, "‘’“”«»", "''\"\"\"\"")
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def cue_paragraphs(c: Column, cues: list[str], least: int = 60) -> Column:
    """Paragraphs long enough that hold one of the cue words."""
    pattern = r"(?i)\b(?:" + "|".join(cues) + r")\b"
    return F.filter(paragraphs(c), lambda p: (F.length(p) >= least) & p.rlike(pattern))


def markers(c: Column, kind: str = "c") -> Column:
    """Ids in citation marks such as [c:12]."""
    return F.regexp_extract_all(c, F.lit(rf"\[{kind}:([A-Za-z0-9_-]+)\]"), F.lit(1))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text's words, each padded by two blanks before and one after."""
    words = F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared part of two arrays of trigrams; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def joined_sha1(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def seed_of(c: Column) -> Column:
    """A number from the first 12 hex digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 12), 16, 10).cast("long")


def redacted(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(key|token|secret|password)=[^&\s]+", "$1=***")


def role_weight(role: Column, core: float = 1.0, session: float = 0.6, mastering: float = 0.3) -> Column:
    """A credit's weight by its role: mastering; producing, writing, composing and lyrics; all else, such as playing or engineering."""
    low = F.lower(role)
    return F.when(low.contains("master"), mastering).when(low.rlike("produc|writ|compos|lyric"), core).otherwise(session)


def verbatim(docs: DataFrame, doc_id: str, text: str, quotes: DataFrame, quote_id: str, quote: str, words: int = 6, broadcast_quotes: int = 500_000) -> DataFrame:
    """Pairs of a document and a quote that it holds as whole words, letters' case and kinds of blanks aside.

    A quote is looked up by a hash of its first words (all of them if it has fewer than `words`), and then compared whole in
    the documents found. Empty quotes are in no document. Up to broadcast_quotes quotes are sent to the documents, so that no
    run of words is shuffled; beyond, the runs are dealt out by hash.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    split = lambda c: F.array_remove(F.split(c, " "), "")
    asked = quotes.select(F.col(quote_id), plain(F.col(quote)).alias("_quote")).where("_quote <> ''").withColumn("_n", F.least(F.size(split(F.col("_quote"))), F.lit(words)))
    # The number of words is part of the hash: one long tells runs of every length apart.
    run_hash = lambda n, run: F.xxhash64(n, run)
    asked = kept(asked.select(quote_id, "_quote", "_n", run_hash(F.col("_n"), F.slice(split(F.col("_quote")), 1, F.col("_n"))).alias("_h")), "quotes")
    lengths = [r[0] for r in asked.select("_n").distinct().collect()]  # `words` numbers at most
    if not lengths:
        return docs.select(doc_id).limit(0).join(asked.select(quote_id))
    cut = docs.select(F.col(doc_id), split(plain(F.col(text))).alias("_w"))
    runs = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: run_hash(F.lit(n), F.slice("_w", i, n)))).otherwise(F.array().cast("array<bigint>"))
    places = cut.select(doc_id, F.explode(F.concat(*map(runs, lengths))).alias("_h"))
    found = kept(places.join(broadcast_if_small(asked.select("_h", quote_id), broadcast_quotes), "_h").select(doc_id, quote_id).distinct(), "found")
    # Only documents with a place are read again; what is found is usually small enough to be sent to them.
    body = docs.select(F.col(doc_id), plain(F.col(text)).alias("_body"))
    pairs = body.join(broadcast_if_small(found.join(asked.select(quote_id, "_quote"), quote_id), broadcast_quotes // 10), doc_id)
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return pairs.where(F.contains(spaced("_body"), spaced("_quote"))).select(doc_id, quote_id)


#: Up to so many characters (a text's times its pieces) are searched plainly; so many pieces of one text are looked up in a task.
PLAIN_SEARCH, PIECES_PER_TASK = 20_000_000, 200_000


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points (a power of two) from each place on."""
    h, n = codes.astype(np.uint64), 1
    while n < q:
        h = (h[:-n] * np.uint64(0x9E3779B97F4A7C15) + (h[n:] ^ (h[n:] >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        n *= 2
    return h


def contained(body: str, pieces: list[str]) -> list[bool]:
    """Whether a text holds each of these pieces. Of many pieces each is looked up by its rarest gram, then compared in its places."""
    if len(body) * len(pieces) <= PLAIN_SEARCH:
        return [x in body for x in pieces]
    found = [x == "" for x in pieces]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = codes(body)
    for q in (1, 2, 4, 8, 16):
        own = [i for i, x in enumerate(pieces) if q <= len(x) <= len(body) and (len(x) < 2 * q or q == 16)]
        if not own:
            continue
        grams = _grams(text, q)
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        sizes = np.array([len(pieces[i]) for i in own])
        starts = np.cumsum(sizes) - sizes
        asked = _grams(codes("".join(pieces[i] for i in own)), q)
        low = np.searchsorted(grams, asked)
        places = np.searchsorted(grams, asked, "right") - low
        for i, start, size in zip(own, starts, sizes):
            k = int(np.argmin(places[start : start + size - q + 1]))
            at = low[start + k]
            found[i] = any(body.startswith(pieces[i], p) for p in (order[at : at + places[start + k]] - k).tolist() if p >= 0)
    return found


def held_pieces(asked: DataFrame, bodies: DataFrame) -> DataFrame:
    """at, piece: those of asked (at, piece; distinct rows come back) that the text of that name holds. bodies: at, body."""
    rows = kept(asked.select("at", "piece").where("at is not null and piece is not null").distinct(), "pieces")
    most = rows.groupBy("at").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    parts = max(1, -(-most // PIECES_PER_TASK))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(parts)))
    texts = bodies.select("at", "body").where("body is not null").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pieces = left["piece"].tolist()
        held = np.zeros(len(pieces), bool)
        for body in right["body"] if pieces else []:
            held |= np.array(contained(body, pieces), bool)
        return left.loc[held, ["at", "piece"]]

    return dealt.groupBy("at", "part").cogroup(texts.groupBy("at", "part")).applyInPandas(search, "at string, piece string")


def similar_names(asked: DataFrame, known: DataFrame, name: str, least: float) -> DataFrame:
    """asked, found, score: names whose trigrams are alike by at least this share of both; distinct names are expected.

    An equi-join on rare trigrams: of g trigrams (rarest first, by how many known names have them) one of the first
    g - ceil(least * g) + 1 must be common; numbers of trigrams that can't reach the share are left out.
    """
    side = lambda df, k: df.select(F.col(name).alias(k), trigrams(F.col(name)).alias(f"g_{k}"))
    a, b = side(asked, "asked"), side(known, "found")
    counts = b.select(F.explode("g_found").alias("g")).groupBy("g").agg(F.count("*").alias("df"))

    def heads(df: DataFrame, k: str) -> DataFrame:
        ordered = df.select(k, F.explode(f"g_{k}").alias("g")).join(counts, "g", "left").groupBy(k).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("o"))
        n = F.size("o")
        return ordered.select(k, n.alias(f"n_{k}"), F.posexplode(F.slice("o", 1, (n - F.ceil(n * least) + 1).cast("int"))).alias(f"at_{k}", "e")).select(k, f"n_{k}", f"at_{k}", F.col("e.g").alias("g"))

    # At the first trigram that both have, enough must stand behind it on either side; and sizes must let the share be reached.
    n_a, n_b = F.col("n_asked"), F.col("n_found")
    behind = F.least(n_a - F.col("at_asked"), n_b - F.col("at_found")) >= F.ceil(least / (1 + least) * (n_a + n_b) - 1e-9)
    met = heads(a, "asked").join(heads(b, "found"), "g").where((F.least(n_a, n_b) >= least * F.greatest(n_a, n_b)) & behind)
    pairs = met.select("asked", "found").distinct().join(a, "asked").join(b, "found")
    return pairs.withColumn("score", similarity(F.col("g_asked"), F.col("g_found"))).where(F.col("score") >= least).select("asked", "found", "score")


def mentioned_near(body: Column, a: str, b: str, within: int) -> Column:
    """Whether two words stand within so many characters of each other, in either order, not overlapping."""
    gap = rf"[\s\S]{{0,{within}}}"
    return F.coalesce(body.rlike(rf"\b{a}\b{gap}\b{b}\b|\b{b}\b{gap}\b{a}\b"), F.lit(False))


def own_words_near(body: Column, a: Column, b: Column, within: int) -> Column:
    """Whether two words that each row names (literally, as whole words) stand within so many characters of each other, in either
    order, not overlapping. One pass over the text: from each place of the one no further than the other may stand."""
    whole = lambda word: F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}_])"))
    gap = F.lit(rf"[\s\S]{{0,{within}}}?")
    near = F.rlike(body, F.concat(whole(a), gap, whole(b), F.lit("|"), whole(b), gap, whole(a)))
    return F.coalesce(near & (a != "") & (b != ""), F.lit(False))
