"""Fuzzy line dedup by MinHash, in DataFrame functions only: one line of each component of near-equal lines stays.

A line's set is its shingles of SHINGLE characters (a shorter line is one shingle). Two lines are near if the Jaccard
similarity of their sets is 0.8 or more. Signatures of BANDS * ROWS minima (one permutation, by bins) are cut into bands;
lines that share a band are candidates (found with probability 0.995 at a similarity of 0.8, 0.99999 at 0.9, a little
less where a line has few shingles). Equal lines are one line from the
start. Of the lines of a band the most central one (that shares most bands, then the greatest hash) is compared with all
others; where a band still holds several components, so is one line drawn by hash. What is left after that, lines of one
band but of different components, is compared to the last pair: directly in bands of up to FEW lines, in larger ones by
an exact join on the rarest shingles, of which near lines must share one. Similarities are exact over the hashes of all
shingles (64 bits); links make components by distributed union-find. The first line of a component, by document id and
place, stays; all others go.

Null and empty texts have no lines, rows with a null id keep all of theirs. Blank lines stay and are never compared. Ties
go to the least id and place. Repeated rows of one id share their places: lines removed go from each. A very long text is
many lines like any other; a single very long line is held whole, as one value of one row. Other columns are kept as they
are, but a column named lines_total or lines_removed is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import WorkTables, broadcast_if_small, looked_up

SHINGLE, BANDS, ROWS, PERCENT = 9, 10, 4, 80
#: An empty bin of a signature looks into so many others.
PROBES = 5
#: Up to so many candidate lines (two longs each) are sent to all executors; beyond, lines are shuffled to them.
BROADCAST_LINES = 500_000
#: Marks of lost lines are sent to all executors up to so many bytes; beyond, documents are shuffled to them.
BROADCAST_MARKS = 16_000_000
#: Longs of marks of a line: 64 bits each.
WORDS = 32
#: Bands of up to so many lines are compared in pairs; the lines of larger ones first by their rarest shingles.
FEW = 32
#: A line or band that holds more than one row in so many is looked up by broadcast: there are at most as many of these.
HOT_SHARE, HOT_LEAST = 1000, 1000
_BREAK = "\n"


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank: id, place, line, key. docs: id, text."""
    split = docs.where("id is not null").select("id", F.posexplode(F.split("text", _BREAK)).alias("place", "line"))
    return split.where(F.trim("line") != "").withColumn("key", F.xxhash64("line"))


def _shingles(lines: DataFrame, *carried: str) -> DataFrame:
    """One row for every shingle, within the task: carried columns, i (the shingle's place), h (its hash).

    Four bytes hold a character here, so a shingle is found by its place, however long the line.
    """
    wide = lines.select(*carried, F.encode("line", "UTF-32").alias("data"), F.length("line").alias("n"))
    placed = wide.select(*carried, "data", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - SHINGLE, F.lit(0)))).alias("i"))
    return placed.select(*carried, "i", F.xxhash64(F.substring("data", F.col("i") * 4 + 1, F.lit(4 * SHINGLE))).alias("h"))


def _signatures(lines: DataFrame) -> DataFrame:
    """key, id (of the first document that has it), lines (how many are equal), bands: one row per different line.

    Equal lines are one row before they are cut into shingles. That row's key has dealt it to its task, so its shingles are
    summed up where they are made: minima are never shuffled. One permutation, cut into BANDS * ROWS bins: a shingle counts
    in the bin of its hash only. A bin that holds none borrows from PROBES others, in an order of its own, and at last the
    least of all.
    """
    bins = BANDS * ROWS
    different = lines.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("lines"), F.first("line").alias("line"))
    shingles = _shingles(different, "key", "id", "lines").withColumn("bin", F.pmod("h", F.lit(bins)))
    minima = [F.expr(f"min(h) FILTER (WHERE bin = {n})").alias(f"m{n}") for n in range(bins)]
    signed = shingles.groupBy("key").agg(F.max("id").alias("id"), F.max("lines").alias("lines"), *minima)
    # Minima are one array: written out for each bin, borrowing would be a very long method.
    signed = signed.select("key", "id", "lines", F.array(*(f"m{n}" for n in range(bins))).alias("m"))
    probes = F.array(*(F.array(*map(F.lit, _probes(n, bins))) for n in range(bins)))
    borrowed = lambda n: (F.get("m", F.get(F.get(probes, n), F.lit(p))) for p in range(1, PROBES + 1))
    filled = signed.select("key", "id", "lines", F.transform("m", lambda m, n: F.coalesce(m, *borrowed(n), F.array_min("m"))).alias("m"))
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.get("m", F.lit(b * ROWS + r)) for r in range(ROWS))) for b in range(BANDS)))
    return filled.select("key", "id", "lines", bands.alias("bands"))


def _probes(n: int, bins: int) -> list[int]:
    """Bin n and the PROBES others that it borrows from."""
    return [n, *random.Random(n).sample([k for k in range(bins) if k != n], PROBES)]


def _hashes(line: Column) -> Column:
    """The shingles (hashes) of one line, as an array; repeated ones are repeated there."""
    n = F.length(line)
    of = lambda data: F.transform(F.sequence(F.lit(1), 4 * (n - SHINGLE) + 1, F.lit(4)), lambda at: F.xxhash64(F.substring(data, at, F.lit(4 * SHINGLE))))
    # The array around the encoded line makes it once for all places.
    every = F.get(F.transform(F.array(F.encode(line, "UTF-32")), of), F.lit(0))
    return F.when(n <= SHINGLE, F.array(F.xxhash64(line))).otherwise(every)


def _set(line: Column) -> Column:
    """The different shingles (hashes) of one line, as an array."""
    return F.array_distinct(_hashes(line))


def _texts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """key, line, n (how many different shingles): the lines wanted (id, key), one row each.

    Lines are kept and not their sets, which take eight times as much to write and to shuffle.
    """
    found = lines.select("id", "key", "line").join(broadcast_if_small(wanted.select("id", "key"), BROADCAST_LINES), ["id", "key"])
    return found.dropDuplicates(["key"]).select("key", "line", F.size(_set(F.col("line"))).cast("long").alias("n"))


def _marks(texts: DataFrame) -> DataFrame:
    """key, n (how many different shingles), marks (WORDS longs): every shingle sets one bit of its line's marks."""
    shingles = _shingles(texts.withColumnRenamed("n", "different"), "key", "different")
    bits = shingles.select("key", "different", F.pmod("h", F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))").alias("bit"))
    words = [F.expr(f"coalesce(bit_or(bit) FILTER (WHERE word = {w}), 0L)").alias(f"w{w}") for w in range(WORDS)]
    summed = bits.groupBy("key").agg(F.max("different").alias("n"), *words)
    return summed.select("key", "n", F.array(*(f"w{w}" for w in range(WORDS))).alias("marks"))


def _maybe(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: pairs without those that can't be near by their counts and marks; no near pair is lost.

    A shingle that both lines have sets the same bit in both, so there are at least as many shingles that only one has
    as there are bits that differ.
    """
    side = lambda k: marks.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("marks").alias(f"marks_{k}"))
    alike = PERCENT * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")
    every = F.col("n_a") + F.col("n_b")
    differ = sum((F.bit_count(F.get("marks_a", F.lit(w)).bitwiseXOR(F.get("marks_b", F.lit(w)))) for w in range(WORDS)), F.lit(0))
    # If d shingles are in one line only, (every - d) / 2 are in both.
    room = (100 + PERCENT) * (every - differ) >= 2 * PERCENT * every
    return pairs.join(side("b"), "b").join(side("a"), "a").where(alike).where(room).select("a", "b", "n_a", "n_b")


def _links(pairs: DataFrame, texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose sets are near, compared exactly."""
    side = lambda k: texts.select(F.col("key").alias(k), F.col("line").alias(f"line_{k}"))
    both = F.size(F.array_intersect(_hashes(F.col("line_a")), _hashes(F.col("line_b"))))
    # Of intersection size x the union is n_a + n_b - x, so x is wanted only once.
    near = (100 + PERCENT) * both >= PERCENT * (F.col("n_a") + F.col("n_b"))
    return _maybe(pairs, marks).join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")


def _mixed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """band, key, c: rows with their component, only of bands that hold several components."""
    labelled = rows.select("band", "key").join(parts, F.col("key") == parts.node, "left").select("band", "key", F.coalesce("component", "key").alias("c"))
    mixed = labelled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band")
    return labelled.join(mixed, "band", "left_semi")


def _star(rows: DataFrame, leaders: DataFrame, apart: Column | None = None) -> DataFrame:
    """Every row of a band with the band's leader: pairs (a, b), a < b."""
    met = looked_up(rows, "band", leaders).where(F.col("key") != F.col("lead"))
    met = met if apart is None else met.where(apart)
    return met.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()


def _across(rows: DataFrame, texts: DataFrame, marks: DataFrame, work: WorkTables) -> DataFrame:
    """Pairs (a, b) from different components that may be near: all pairs of a band that can be.

    rows: band, key, c. texts: key, line. marks: key, n. Pairs of large bands come from a join on shingles, rarest first: of n shingles
    near lines share one among the first n - ceil(0.8 n) + 1, their prefix, and at the first one they share, enough must
    stand behind it. A pair is made at this first one only, and only if what both prefixes share leaves room for enough
    beyond them. This join doesn't ask for a common band, so it may find pairs that no band has.
    """
    counts = work.keep(rows.groupBy("band").agg(F.count("*").alias("m")))
    alike = 100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")
    apart = (F.col("x.key") < F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & alike
    pair = (F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    few = work.keep(rows.join(counts.where(F.col("m") <= FEW), "band", "left_semi").join(marks.select("key", "n"), "key"))
    direct = few.alias("x").join(few.alias("y"), (F.col("x.band") == F.col("y.band")) & apart).select(*pair)
    crowd = work.keep(rows.join(counts.where(F.col("m") > FEW), "band", "left_semi").select("key", "c").distinct())
    if not crowd.limit(1).count():
        return direct.distinct()
    shingles = work.keep(texts.select("key", "line").join(crowd, "key").select("key", "c", F.explode(_set(F.col("line"))).alias("h")))
    most = max(HOT_LEAST, shingles.count() // HOT_SHARE)
    hot = [r[0] for r in shingles.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > most).select("h").collect()]  # HOT_SHARE hashes at most
    # Shingles of hot ones come last, by hash; those of all others are counted where they meet.
    counted = shingles.where(~F.col("h").isin(hot)).withColumn("df", F.count("*").over(Window.partitionBy("h")))
    ranked = counted.unionByName(shingles.where(F.col("h").isin(hot)).withColumn("df", F.lit(1 << 62)))
    ordered = ranked.groupBy("key", "c").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    n = F.size("hs").cast("long")
    prefix = F.slice("hs", 1, (n - F.ceil(n * PERCENT / 100) + 1).cast("int"))
    prefixes = work.keep(ordered.select("key", "c", n.alias("n"), F.posexplode(prefix).alias("at", "e")).select("key", "c", "n", "at", F.col("e.h").alias("h")))
    work.drop(shingles)
    several = prefixes.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h")
    entries = work.keep(prefixes.join(several, "h", "left_semi"))
    work.drop(prefixes)
    # Every entry carries its line's prefix (a fifth of the line's shingles at most) as far as it matters.
    lines = entries.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("p")).select("key", F.transform("p", lambda e: e["h"]).alias("p"))
    entries = work.keep(entries.join(lines, "key"))
    both = F.array_intersect("x.p", "y.p")
    need = F.ceil(PERCENT * (F.col("x.n") + F.col("y.n")) / (100 + PERCENT))
    behind = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need
    beyond = F.greatest(*(F.ceil(F.col(f"{side}.n") * PERCENT / 100) - 1 for side in "xy"))
    once = (F.get(both, F.lit(0)) == F.col("x.h")) & (F.size(both) + beyond >= need)
    rarest = entries.alias("x").join(entries.alias("y"), (F.col("x.h") == F.col("y.h")) & apart & behind & once).select(*pair)
    return direct.union(rarest).distinct()


def _merged(parts: DataFrame, links: DataFrame, work: WorkTables) -> DataFrame:
    """parts (node, component) after more links: only the components that these join are looked at again."""
    of = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = work.keep(components(ends, work))
    moved = parts.join(joined.withColumnRenamed("node", "c").withColumnRenamed("component", "to"), F.col("component") == F.col("c"), "left")
    # A line that was alone until now is its own component and has no row in parts.
    alone = joined.join(parts.select("node"), "node", "left_anti")
    return work.keep(moved.select("node", F.coalesce("to", "component").alias("component")).union(alone.select("node", "component")))


def line_components(lines: DataFrame, work: WorkTables) -> tuple[DataFrame, DataFrame]:
    """Of every different line: key, id, lines; and the components of near ones: node, component (both keys)."""
    signatures = work.keep(_signatures(lines))
    # Few bands are shared: the rows of a band meet once, with nothing but their keys, and only those of shared bands go on.
    met = signatures.select("key", F.explode("bands").alias("band")).withColumn("m", F.count("*").over(Window.partitionBy("band")))
    rows = work.keep(met.where("m > 1").select("key", "band"))
    signed = work.keep(signatures.select("key", "id", "lines"))
    work.drop(signatures)
    # Of a line and its edited copies, the line itself shares the most bands.
    near = work.keep(rows.groupBy("key").agg(F.count("*").cast("int").alias("degree")))
    texts = work.keep(_texts(signed.join(near, "key"), lines))
    marks = work.keep(_marks(texts))
    rows = work.keep(rows.join(near, "key"))
    work.drop(near)
    hot = F.count("*") > F.lit(max(HOT_LEAST, rows.count() // HOT_SHARE))
    leaders = rows.groupBy("band").agg(F.max(F.struct("degree", "key")).alias("l"), hot.alias("hub")).select(F.col("band").alias("v"), F.col("l.key").alias("lead"), "hub")
    pairs = work.keep(_star(rows, work.keep(leaders)))
    parts = work.keep(components(work.keep(_links(pairs, texts, marks)), work))
    # Each band that still has several components draws another leader, by hash: a line meets many of its group before
    # the rest is compared in pairs.
    rows = work.keep(_mixed(rows, parts))
    if not rows.limit(1).count():
        return signed, parts
    drawn = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64("key", "band"), "key", "c")).alias("l"), hot.alias("hub")).select(F.col("band").alias("v"), F.col("l.key").alias("lead"), F.col("l.c").alias("lead_c"), "hub")
    again = work.keep(_star(rows, work.keep(drawn), F.col("c") != F.col("lead_c")).join(pairs, ["a", "b"], "left_anti"))
    closer = work.keep(_links(again, texts, marks))
    if closer.limit(1).count():
        parts = _merged(parts, closer, work)
        rows = work.keep(_mixed(rows, parts))
    across = work.keep(_across(rows, texts, marks, work).join(pairs.union(again), ["a", "b"], "left_anti"))
    more = work.keep(_links(across, texts, marks))
    if more.limit(1).count():
        parts = _merged(parts, more, work)
    return signed, parts


def _gone(lines: DataFrame, work: WorkTables) -> DataFrame:
    """id, n, mask: for every document that loses lines, how many, and a text with 1 at the places of these, 0 before."""
    signed, parts = line_components(lines, work)
    # A line that has no copies and is near no other stays: most go no further than this.
    several = signed.join(parts, signed.key == parts.node, "left").where("lines > 1 or node is not null")
    keyed = work.keep(several.select("key", "id", "lines", F.coalesce("component", "key").alias("c")))
    kept = keyed.groupBy("c").agg(F.min("id").alias("kept"))
    total = signed.agg(F.sum("lines")).first()[0] or 0
    hub = F.col("lines") > max(HOT_LEAST, total // HOT_SHARE)
    values = work.keep(keyed.join(kept, "c").select(F.col("key").alias("v"), "c", "kept", hub.alias("hub")))
    placed = work.keep(lines.select("id", "place", "key"))
    crowd = work.keep(looked_up(placed, "key", values).select("id", "place", "c", F.col("id").eqNullSafe(F.col("kept")).alias("first")))
    first = crowd.where("first").groupBy("c").agg(F.min("place").alias("first_place"))
    stays = crowd.where("first").join(first, "c").where(F.col("place") == F.col("first_place")).select("id", "place").distinct()
    places = crowd.select("id", "place").join(stays, ["id", "place"], "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    gap = lambda p, k: p - F.when(k > 0, F.get("places", k - 1)).otherwise(F.lit(-1)) - 1
    marks = F.transform("places", lambda p, k: F.concat(F.repeat(F.lit("0"), gap(p, k)), F.lit("1")))
    return work.keep(places.select("id", F.size("places").cast("long").alias("n"), F.array_join(marks, "").cast("binary").alias("mask")))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with text shortened, and lines_total, lines_removed (long). A null text stays null."""
    work = WorkTables(docs.sparkSession, "line_dedup")
    docs = docs.drop("lines_total", "lines_removed")
    lines = _lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    found = _gone(lines, work)
    work.only(found)
    few = (found.agg(F.sum(F.length("mask") + 40)).first()[0] or 0) <= BROADCAST_MARKS
    gone = (F.broadcast(found) if few else found).alias("gone")
    split = F.split(F.col(text_col).cast("string"), _BREAK)
    some = F.col("gone.n").isNotNull()
    left = F.filter(split, lambda _, i: F.substring(F.col("gone.mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    joined = docs.alias("docs").join(gone, F.col(f"docs.{id_col}") == F.col("gone.id"), "left")
    whole = lambda c: F.col(f"docs.`{c}`")
    return joined.select(
        *(F.when(some, F.array_join(left, _BREAK)).otherwise(whole(c)).alias(c) if c == text_col else whole(c) for c in docs.columns),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("lines_total"),
        # A row of a repeated id may have fewer lines than the places that go.
        F.when(F.length("gone.mask") > F.size(split), F.size(split) - F.size(left)).otherwise(F.coalesce("gone.n", F.lit(0))).cast("long").alias("lines_removed"),
    )
