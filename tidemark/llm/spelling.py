"""Groups spelling variants: a trie self-join with active-node sets, at a distance of one.

The vocabulary becomes a Patricia trie, partitioned by ranges of its sorted words, so by prefix; a frequent prefix is
several ranges. A node is its prefix. The active nodes of a node are those whose prefixes are at a distance of one from
its own; a node itself, at distance nought, needs no row. They begin where two words part, which is at a point of the trie:
two children that differ by their letter (a replacement), or a child beside its own parent (a letter more). From there
both sides must go on alike. Each round compares what is left of both edges, drops pairs that differ or that no common
letter leads on from, gives out pairs of words that end together, and steps down where an edge has ended, by a join on
node and letter. Every pair of words is met once, where they part, so nothing is counted twice; a node has few children,
so no key of these joins is hot. There are as many rounds as branches on a path, not letters: long words cost one compare.

Words and counts come from all texts: partial counts are made before the shuffle, so that a very frequent word is one row
of each partition. Null texts and ids: a null text has no words; a null id counts as an empty one. Empty texts have no
words; a very long run is one word like any other. Repeated rows are counted each. Ties of counts go to the smaller word
in code-point order. Other columns don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patricia import compressed, in_ranges
from .shared import WorkTables, ascii_lower, broadcast_if_small

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a letter in with_planted_slips.
SLIP_SHARE = 97
#: Children of the trie are broadcast up to so many rows (of about 100 bytes); beyond, they are joined by a shuffle.
BROADCAST_CHILDREN = 300_000
#: Forms of forms are followed by doubling; counts at least double with each, so a chain has under 64 words.
MAX_STEPS = 7


def letter_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (as text), run (A to Z lower-cased): one row for every maximal run of letters of every text."""
    runs = F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(LETTERS), F.lit(0)))
    return docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))


def with_planted_slips(runs: DataFrame) -> DataFrame:
    """word: the run, without one letter where SLIP_SHARE divides the crc32 of id and run."""
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    hashed = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % SLIP_SHARE == 0, cut).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: how often, of words long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """parent, child (both prefixes): the edges of each range's trie."""

    def rows():
        for batch in batches:
            yield from zip(batch["pid"], batch["kind"], batch["word"])

    def one_range(first, pid):
        nonlocal pending
        yield first
        for at, kind, word in stream:
            if at != pid:
                pending = at, kind, word
                return
            yield kind, word, _NoWeights(), 1, 0
        pending = None

    stream, out = rows(), []
    pending = next(stream, None)
    while pending:
        pid, kind, word = pending
        source = one_range((kind, word, _NoWeights(), 1, 0), pid)
        for _, path, _, top, p, _ in compressed(source, None, None):
            if top >= 0:
                out.append((path[:top], path[: p.depth]))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["parent", "child"])
                out = []
        for _ in source:
            pass
    yield pd.DataFrame(out, columns=["parent", "child"])


class _NoWeights:
    """Weights of a path of letters: none is asked for."""

    def __getitem__(self, at):
        return [] if isinstance(at, slice) else 0


def children(vocabulary: DataFrame, work: WorkTables) -> DataFrame:
    """parent, c (first letter below it), child, kids (first letters below the child), n (the child's, 0 if it is no word)."""
    ranges = in_ranges(vocabulary.select("word"), "word", work).select("pid", "kind", "word")
    edges = work.keep(ranges.mapInPandas(_edges, "parent string, child string").distinct())
    below = edges.withColumn("c", F.substring("child", F.length("parent") + 1, F.lit(1)))
    kids = below.groupBy(F.col("parent").alias("child")).agg(F.concat_ws("", F.sort_array(F.collect_set("c"))).alias("kids"))
    full = below.join(kids, "child", "left").join(vocabulary.select(F.col("word").alias("child"), "n"), "child", "left")
    return full.select("parent", "c", "child", F.coalesce("kids", F.lit("")).alias("kids"), F.coalesce("n", F.lit(0)).alias("n"))


_NODE = ("child", "kids", "n")


def near_pairs(vocabulary: DataFrame, work: WorkTables) -> DataFrame:
    """a, n_a, b, n_b: every two words of vocabulary (word, n) that differ by one letter put in, left out or replaced; each
    pair once, in any order.

    An active pair is two nodes (child_*), with what is left to read of the edge into each (rest_*); not_b is a letter that
    side b may not go on with, as both sides would then part further down.
    """
    trie = work.keep(children(vocabulary, work))
    none = F.lit("")
    of = lambda df, side: [df[c].alias(f"{c}_{side}") for c in _NODE]
    behind_first = lambda df: F.substring(df["child"], F.length(df["parent"]) + 2, F.length(df["child"]))
    x, y = trie.alias("x"), trie.alias("y")
    named = lambda side: {c: F.col(f"{side}.{c}") for c in (*_NODE, "parent", "c")}
    replaced = x.join(y, (F.col("x.parent") == F.col("y.parent")) & (F.col("x.c") < F.col("y.c")))
    replaced = replaced.select(*of(named("x"), "a"), behind_first(named("x")).alias("rest_a"), *of(named("y"), "b"), behind_first(named("y")).alias("rest_b"), none.alias("not_b"))
    # A letter more on side a: the child's first one is read, its parent stays. The root is no word and no child.
    root = trie.where("parent = ''").agg(F.concat_ws("", F.sort_array(F.collect_set("c"))).alias("kids")).select(none.alias("parent"), "kids", F.lit(0).cast("long").alias("n"))
    above = trie.select(F.col("child").alias("parent"), "kids", "n").unionByName(root)
    below = trie.join(above.select("parent", F.col("kids").alias("kids_b"), F.col("n").alias("n_b")), "parent")
    longer = below.select(*of(below, "a"), behind_first(below).alias("rest_a"), F.col("parent").alias("child_b"), "kids_b", "n_b", none.alias("rest_b"), F.col("c").alias("not_b"))
    step = broadcast_if_small(trie.select(F.col("parent").alias("node"), F.col("c").alias("letter"), *_NODE), BROADCAST_CHILDREN)

    ended, open_ = (F.col("rest_a") == "") & (F.col("rest_b") == ""), []
    active = replaced.unionByName(longer)
    while True:
        # After reading what both edges have in common at least one of them has ended.
        state = work.keep(_alike(active))
        open_.append(state.where(ended & (F.col("n_a") > 0) & (F.col("n_b") > 0)).select(F.col("child_a").alias("a"), "n_a", F.col("child_b").alias("b"), "n_b"))
        if not state.where(~ended | (F.col("go") != "")).limit(1).count():
            return reduce(DataFrame.union, open_)
        # Where both have ended, side a goes first, by each common letter; else the side that has ended follows the other.
        both = state.where(ended & (F.col("go") != "")).withColumn("letter", F.explode(F.split("go", "")))
        a_next = both.unionByName(state.where("rest_a = '' and rest_b <> ''").withColumn("letter", F.substring("rest_b", 1, 1)))
        b_next = state.where("rest_a <> '' and rest_b = ''").withColumn("letter", F.substring("rest_a", 1, 1))
        rest = F.expr("substring(child, length(node) + 1)")
        one = a_next.withColumn("node", F.col("child_a")).join(step, ["node", "letter"])
        one = one.select(*of(one, "a"), rest.alias("rest_a"), "child_b", "kids_b", "n_b", "rest_b", "not_b")
        other = b_next.withColumn("node", F.col("child_b")).join(step, ["node", "letter"])
        other = other.select("child_a", "kids_a", "n_a", "rest_a", *of(other, "b"), rest.alias("rest_b"), none.alias("not_b"))
        active = one.unionByName(other)


def _alike(active: DataFrame) -> DataFrame:
    """Active pairs with what both edges have in common read, without those that can't go on; go: if both have ended, the
    letters by which both can."""
    m = F.least(F.length("rest_a"), F.length("rest_b"))
    begin = lambda c: F.substring(c, F.lit(1), F.col("m"))
    left = lambda c: F.substring(c, F.col("m") + 1, F.length(c))
    alike = active.withColumn("m", m).where(begin("rest_a") == begin("rest_b"))
    cut = alike.withColumn("rest_a", left("rest_a")).withColumn("rest_b", left("rest_b")).drop("m")
    ended = (F.col("rest_a") == "") & (F.col("rest_b") == "")
    common = F.filter(F.split("kids_a", ""), lambda c: (c != "") & F.contains(F.col("kids_b"), c) & (c != F.col("not_b")))
    cut = cut.withColumn("go", F.when(ended, F.array_join(common, "")).otherwise(F.lit("")))
    leads = lambda kids, rest: F.contains(F.col(kids), F.substring(rest, 1, 1))
    b_next = leads("kids_b", "rest_a") & (F.substring("rest_a", 1, 1) != F.col("not_b"))
    goes = F.when(ended, ((F.col("n_a") > 0) & (F.col("n_b") > 0)) | (F.col("go") != "")).when(F.col("rest_a") == "", leads("kids_a", "rest_b")).otherwise(b_next)
    return cut.where(goes)


def group_variants(counted: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root. counted: word, n (different words).

    A word's form is its most frequent near word, if that occurs at least RATIO times as often; its root is the last form
    of its form's forms.
    """
    work = WorkTables(counted.sparkSession, "spelling")
    vocabulary = work.keep(counted.select("word", "n"))
    pairs = work.keep(near_pairs(vocabulary, work))
    near = pairs.select(F.col("a").alias("word")).union(pairs.select("b")).groupBy("word").agg(F.count("*").alias("n_near"))
    # Only pairs with enough between their counts can give a form; a word's pairs are few, so no word is hot.
    enough = lambda a, b: pairs.where(F.col(f"n_{b}") >= RATIO * F.col(f"n_{a}")).select(F.col(a).alias("word"), F.col(b).alias("form"), F.col(f"n_{b}").alias("form_n"))
    best = enough("a", "b").union(enough("b", "a")).groupBy("word").agg(F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best"))
    joined = vocabulary.join(near, "word", "left").join(best, "word", "left")
    rows = work.keep(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")))
    roots = work.keep(_roots(rows.where("form is not null").select("word", "form"), work))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, work: WorkTables) -> DataFrame:
    """word, root of words with a form: each round looks twice as far. Words that have reached their root are not joined on."""
    hops, done = work.keep(forms), None
    for _ in range(MAX_STEPS):
        every = hops if done is None else hops.union(done)
        looked = work.keep(hops.join(every.select(F.col("word").alias("form"), F.col("form").alias("next")), "form", "left"))
        there = looked.where("next is null").select("word", "form")
        done = there if done is None else done.union(there)
        hops = looked.where("next is not null").select("word", F.col("next").alias("form"))
        if not hops.limit(1).count():
            return done.select("word", F.col("form").alias("root"))
    raise RuntimeError("forms did not settle")
