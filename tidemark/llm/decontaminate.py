"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text becomes words; every run of GRAM words gets a hash; of each window of adjacent hashes the least is kept. Two
texts that share a span of SPAN words share a kept hash, so joining kept hashes misses no such span. Each joined pair of
places is then extended word by word, to the left and right, as far as a span around this place can reach; runs of
SPAN words or more are hits. An item of fewer than SPAN words is one span: for each such length that occurs (at most
SPAN - 1 of them) all runs of that length are hashed instead.

Null or empty texts have no words, no hits and are not contaminated. Items with a null id or no words match nothing.
Repeated rows of one id give one row (the largest counts). Extra columns, whatever their names, are not read. Empty
tables give empty or hit-free results. Very long texts: up to 2^28 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables, ascii_lower

#: What lies between words once A-Z is lower-cased: ASCII other than digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 3
#: A kept hash is one long: 35 bits of hash above 28 bits of place, so that the least hash carries its place.
PLACE_BITS = 28
#: The benchmark's kept hashes are broadcast up to so many rows (about 500 bytes each); beyond, both sides are shuffled.
BROADCAST_PRINTS = 100_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def gram_hashes(words: Column, n: int) -> Column:
    """One hash, with its place, for each run of n words."""
    return F.when(
        F.size(words) >= n,
        F.transform(
            F.slice(words, 1, F.size(words) - n + 1),
            lambda w, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))), 29), PLACE_BITS).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(F.array().cast("array<long>"))


def _least_with(hashes: Column, step: int) -> Column:
    """Each element, or the one step places on where that is less."""
    return F.transform(hashes, lambda x, i: F.least(x, F.get(hashes, i + step)))


def with_hashes(df: DataFrame, words: str, window: int = SPAN - GRAM + 1) -> DataFrame:
    """Adds h: the least hash of every window of adjacent hashes, each place once. Spans double from step to step."""
    out, size = df.withColumn("h", gram_hashes(F.col(words), GRAM)).withColumn("grams", F.size("h")), 1
    while size < window:
        step = min(size, window - size)
        out, size = out.withColumn("h", _least_with(F.col("h"), step)), size + step
    return out.withColumn("h", F.array_distinct(F.slice(F.col("h"), 1, F.greatest(F.col("grams") - window + 1, F.lit(0))))).drop("grams")


def _prints(words: Column, hashes: Column, short: list[int]) -> Column:
    """Kept hashes as (gram, print): gram is the number of words hashed; SPAN-word spans use GRAM, short items their length."""

    def marked(prints: Column, span: int) -> Column:
        return F.transform(prints, lambda x: F.struct(F.lit(span).alias("span"), x.alias("print")))

    kept = [marked(hashes, 0), *(marked(gram_hashes(words, n), n) for n in short)]
    return F.concat(*kept) if short else kept[0]


def _around(words: Column, place: Column, n: Column) -> list[Column]:
    """The words before a place (nearest first), in it, and after it, as far as one span around it reaches."""
    reach = F.lit(SPAN) - n
    low = F.greatest(place - reach, F.lit(0))
    return [F.reverse(F.slice(words, low + 1, place - low)), F.slice(words, place + 1, n), F.slice(words, place + n + 1, F.greatest(reach, F.lit(0)))]


def _alike(a: Column, b: Column) -> Column:
    """How many leading elements are equal."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_share: int = 20, broadcast_prints: int = BROADCAST_PRINTS) -> DataFrame:
    """One row per document: n_words, n_hit, items (sorted array of string), contaminated (n_hit > 0 and min_share * n_hit >= n_words)."""
    work = WorkTables(docs.sparkSession, "decontaminate")
    items = work.keep(
        benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("item_words"))
        .where(F.col("item").isNotNull() & (F.size("item_words") > 0))
        .distinct()
    )
    short = sorted(r[0] for r in items.select(F.size("item_words").alias("n")).where(F.col("n") < SPAN).distinct().collect())  # at most SPAN - 1 numbers
    ilong, ishort = F.size("item_words") >= SPAN, F.size("item_words")
    by_length = F.lit(None).cast("array<long>")
    for n in short:
        by_length = F.when(ishort == n, gram_hashes(F.col("item_words"), n)).otherwise(by_length)
    short_item = F.transform(by_length, lambda x: F.struct(ishort.alias("span"), x.alias("print")))
    of_item = F.when(ilong, _prints(F.col("item_words"), F.col("h"), [])).otherwise(
        short_item
    )
    place = F.col("p.print").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    gram = F.when(F.col("p.span") <= 0, GRAM).otherwise(F.col("p.span"))
    key = [F.col("p.span").alias("span"), F.shiftrightunsigned("p.print", PLACE_BITS).alias("print")]
    prints = work.keep(
        with_hashes(items, "item_words")
        .select("item", "item_words", F.explode(of_item).alias("p"))
        .select("item", *(c.alias(f"item_{c_name}") for c_name, c in zip(("key_span", "key_print"), key)), *(c.alias(f"item_{part}") for part, c in zip(("before", "in", "after"), _around(F.col("item_words"), place, gram))))
    )
    small = prints.limit(broadcast_prints + 1).count() <= broadcast_prints
    # A first print (span -1) stands for the document itself, so that one pass gives its word count too.
    own = F.array(F.struct(F.lit(-1).alias("span"), F.lit(0).cast("long").alias("print")))
    base = with_hashes(docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")), "words")
    exploded = base.select("id", "words", F.explode(F.concat(own, _prints(F.col("words"), F.col("h"), short))).alias("p"))
    around = [c.alias(f"doc_{part}") for part, c in zip(("before", "in", "after"), _around(F.col("words"), place, gram))]
    on = [F.col("span") == F.col("item_key_span"), F.col("print") == F.col("item_key_print")]
    if small:
        joined = (
            exploded.select("id", "words", "p", *key)
            .join(F.broadcast(prints), on, "left")
            .where((F.col("span") == -1) | F.col("item").isNotNull())
            .select("id", "span", F.when(F.col("span") == -1, F.size("words")).alias("n_words"), place.alias("place"), *around, "item", "item_before", "item_in", "item_after")
        )
    else:
        bare = exploded.select("id", F.when(F.col("p.span") == -1, F.size("words")).alias("n_words"), place.alias("place"), *key)
        found = bare.where("span <> -1").join(prints, on)
        text = base.join(found.select("id").distinct(), "id", "left_semi").select("id", "words")
        hits = found.withColumn("p", F.struct("span", F.col("place").cast("long").alias("print"))).join(text, "id")
        joined = bare.where("span = -1").select("id", "span", "n_words").unionByName(
            hits.select("id", "span", "place", *around, "item", "item_before", "item_in", "item_after"), allowMissingColumns=True
        )
    left, right = _alike(F.col("doc_before"), F.col("item_before")), _alike(F.col("doc_after"), F.col("item_after"))
    gram_in = F.size("item_in")
    is_hit = (F.col("doc_in") == F.col("item_in")) & ((F.col("span") > 0) | (left + gram_in + right >= SPAN))
    first = F.when(F.col("span") > 0, F.col("place")).otherwise(F.col("place") - left)
    last = F.when(F.col("span") > 0, F.col("place") + gram_in - 1).otherwise(F.col("place") + gram_in + right - 1)
    counted = (
        joined.select("id", "n_words", F.when(is_hit, F.col("item")).alias("item"), F.when(is_hit, F.sequence(first, last)).alias("hit"))
        .where(F.col("n_words").isNotNull() | F.col("item").isNotNull())
        .groupBy("id")
        .agg(F.max("n_words").cast("long").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    )
    return counted.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))).alias("contaminated"))
