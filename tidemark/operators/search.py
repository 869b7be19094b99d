"""Search by what was typed: names that begin with it, names of which a word does, names that hold it, names like it; then by weight.

All asked strings are answered at once. Each tier is an equi-join over an inverted index of the names: on the heads of their
words, on their rarest run of three letters, and on rare trigrams for what is only alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import similar_names
from ..sources.tables import kept
from .relational import top_per

BEGINS, WORD_BEGINS, HOLDS, LIKE = 1, 2, 3, 4
HEAD = 3


def suggest(asked: DataFrame, names: DataFrame, k: int, least: float = 0.3) -> DataFrame:
    """asked, name, tier, rank: the k best names for every asked string.

    asked: asked (text; blanks around it and capitals don't matter; of one letter or none there is no answer). names: name,
    weight, one row each. A name counts in its best tier; within a tier the greater weight comes first, then the name.
    """
    q = kept(asked.select("asked", F.lower(F.trim("asked")).alias("q")).where(F.length("q") >= 2).distinct(), "asked")
    n = kept(names.select("name", "weight", F.lower("name").alias("low")).where("name is not null"), "names")
    # Heads of two letters are for strings of two; all others look for three.
    words = F.filter(F.split("low", r"\s+"), lambda w: w != "")
    begun = n.select("name", "low", F.explode(F.array_distinct(F.concat(F.array("low"), F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))))).alias("rest"))
    heads = begun.select("name", "low", "rest", F.explode(F.array(F.substring("rest", 1, 2), F.substring("rest", 1, HEAD))).alias("head")).distinct()
    from_q = q.withColumn("head", F.substring("q", 1, HEAD))
    first = from_q.join(heads, "head").where(F.startswith("rest", F.col("q"))).select("asked", "name", F.when(F.startswith("low", F.col("q")), BEGINS).otherwise(WORD_BEGINS).alias("tier"))

    runs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (HEAD - 1)), lambda i: F.substring(c, i, F.lit(HEAD)))
    index = kept(n.where(F.length("low") >= HEAD).select("name", "low", F.explode(F.array_distinct(runs("low"))).alias("run")), "runs")
    counts = index.groupBy("run").agg(F.count("*").alias("n"))
    grams = q.where(F.length("q") >= HEAD).select("asked", "q", F.explode(F.array_distinct(runs("q"))).alias("run")).join(counts, "run", "left")
    # A run that no name has rules the string out.
    rarest = grams.groupBy("asked", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).where("r.n > 0").select("asked", "q", F.col("r.run").alias("run"))
    holding = rarest.join(index, "run").where(F.contains("low", F.col("q"))).select("asked", "name", F.lit(HOLDS).alias("tier"))

    alike = similar_names(q.select(F.col("q").alias("low")).distinct(), n.select("low").distinct(), "low", least)
    alike = alike.join(q.withColumnRenamed("asked", "a"), F.col("asked") == F.col("q")).select(F.col("a").alias("asked"), F.col("found").alias("low")).join(n.select("name", "low"), "low").select("asked", "name", F.lit(LIKE).alias("tier"))
    best = first.unionByName(holding).unionByName(alike).groupBy("asked", "name").agg(F.min("tier").alias("tier")).join(n.select("name", "weight"), "name")
    return top_per(best, ["asked"], k, F.asc("tier"), F.desc("weight"), F.asc("name")).select("asked", "name", "tier", "rank")
