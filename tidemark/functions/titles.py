"""Nearly equal titles: a ratio of matching blocks of at least LEAST_RATIO, found by a join on rare bigrams.

Of two titles with S letters in all and a ratio of r, M = r S / 2 letters of each match, in blocks. Letters that don't match
are S - 2 M, and between two blocks there is one at least, so there are at most 1 + S - 2 M blocks. A block of b letters has
b - 1 bigrams, all in common: at least M - (1 + S - 2 M) = (1.5 r - 1) S - 1 bigrams are. That many common ones imply
that one is among the rarest of each title (prefix filter), which an equi-join finds; no pair within the ratio is lost.
The ratio itself has no native form: only pairs that have enough bigrams in common get to Python.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.tables import kept

LEAST_RATIO, LEAST_LENGTH = 0.85, 4


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype=float)


ratio_udf = F.pandas_udf(_ratios, DoubleType())


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))


def may_match(a: Column, b: Column) -> Column:
    """Equal digit runs, long enough, and lengths that let the ratio be reached: it is at most twice the shorter by the sum."""
    least, total = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return (digit_runs(a) == digit_runs(b)) & (least >= LEAST_LENGTH) & (2 * least >= LEAST_RATIO * total)


def _bigrams(c: Column) -> Column:
    """A title's bigrams, each with how many equal ones stand before it, so that a set counts as the multiset does."""
    plain = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    before = lambda all_, g, i: F.size(F.filter(F.slice(all_, F.lit(1), i), lambda x: x == g))
    # The array around the bigrams makes them once.
    return F.flatten(F.transform(F.array(plain), lambda all_: F.transform(all_, lambda g, i: F.concat(g, before(all_, g, i).cast("string")))))


def _common(letters: Column) -> Column:
    """How many bigrams two titles of so many letters have in common at least."""
    return F.ceil((1.5 * LEAST_RATIO - 1) * letters - 1 - 1e-9)


def _heads(df: DataFrame, title: str, counts: DataFrame) -> DataFrame:
    """title, digits, grams (rarest first), p (its prefix)."""
    exploded = df.select(title, "digits", F.explode("grams").alias("g")).join(counts, ["digits", "g"])
    ordered = exploded.groupBy(title, "digits").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o")).select(title, "digits", F.transform("o", lambda e: e["g"]).alias("grams"))
    # The other title has at least LEAST_RATIO / (2 - LEAST_RATIO) times as many letters.
    least = F.greatest(_common(F.length(title) * (1 + LEAST_RATIO / (2 - LEAST_RATIO))), F.lit(1))
    return ordered.withColumn("p", F.slice("grams", F.lit(1), (F.size("grams") - least + 1).cast("int")))


def near_titles(left: DataFrame, right: DataFrame, title: str) -> DataFrame:
    """title_a, title_b, ratio: pairs of different titles, of left and of right, whose ratio is reached.

    Titles have the same digit runs and LEAST_LENGTH letters at least; nulls and repeated rows don't matter. The ratio of
    matching blocks depends on the order of the two: left's title comes first in it. If left is right, each pair is given
    once, the smaller title first.
    """
    def side(df: DataFrame) -> DataFrame:
        some = df.select(title).where(F.length(title) >= LEAST_LENGTH).distinct()
        return kept(some.select(title, F.concat_ws(",", digit_runs(F.col(title))).alias("digits"), _bigrams(F.col(title)).alias("grams")), "titles")

    a = side(left)
    same = left is right
    b = a if same else side(right)
    every = a if same else a.unionByName(b)
    counts = every.select("digits", F.explode("grams").alias("g")).groupBy("digits", "g").agg(F.count("*").alias("df"))
    x = kept(_heads(a, title, counts), "titles")
    y = x if same else kept(_heads(b, title, counts), "titles")
    of = lambda df, k: df.select("digits", F.col(title).alias(f"title_{k}"), F.col("grams").alias(f"grams_{k}"), F.col("p").alias(f"p_{k}"), F.explode("p").alias("g"))
    letters = F.length("title_a") + F.length("title_b")
    pairs = of(x, "a").join(of(y, "b"), ["digits", "g"]).where("title_a < title_b" if same else "title_a <> title_b")
    # A pair is made at the first bigram that both prefixes have, and only there.
    pairs = pairs.where(2 * F.least(F.length("title_a"), F.length("title_b")) >= LEAST_RATIO * letters).where(F.get(F.array_intersect("p_a", "p_b"), F.lit(0)) == F.col("g"))
    pairs = pairs.where(F.size(F.array_intersect("grams_a", "grams_b")) >= _common(letters)).select("title_a", "title_b")
    return pairs.withColumn("ratio", ratio_udf("title_a", "title_b")).where(F.col("ratio") >= LEAST_RATIO)
