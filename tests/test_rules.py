"""Operators by plain Python where a query's data can't show every case: narrowing, places, texts, upkeep, entries, names, shows."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import texts, variants
from tidemark.operators import claims, entries, graph, relational, search, upkeep
from tidemark.sources import shows, tables


@pytest.mark.parametrize("n", [1, 2, 3])
def test_narrow(spark, n):
    """Conditions in turn, each only where something survives it; nulls fail a condition."""
    rng = random.Random(n)
    rows = [(k, i, *(rng.choice([True, False, False, None]) for _ in range(3))) for i, k in enumerate(rng.choices(range(25), k=120))]
    df = spark.createDataFrame(rows, "k int, i int, c0 boolean, c1 boolean, c2 boolean")
    got = {r.i for r in relational.narrow(df, ["k"], *(F.col(f"c{j}") for j in range(n))).collect()}
    want = set()
    for k in range(25):
        left = [r for r in rows if r[0] == k]
        for j in range(n):
            left = [r for r in left if r[2 + j]] or left
        want |= {r[1] for r in left}
    assert got == want


def test_nearest_goes_round(spark):
    """Neighbours on both sides of the 180th meridian, near the poles, and none within reach."""
    a = spark.createDataFrame([(1, 0.0, 179.9999), (2, 10.0, -179.9999), (3, 89.0, 20.0), (4, 0.0, 0.0)], "a long, lat double, lon double")
    b = spark.createDataFrame([(10, 0.0, -179.9999), (20, 10.0, 179.9998), (30, 89.0, 20.5), (40, 0.0, 1.0)], "b long, lat double, lon double")
    got = {r.a: r.b for r in relational.nearest_within(a, b, 2000, "a", "b").collect()}
    assert got == {1: 10, 2: 20, 3: 30}


def test_own_words(spark):
    rows = [("one two three", "one", "three", 5, True), ("one two three", "one", "three", 4, False), ("a.b a", "a.b", "a", 1, True), ("oneself one", "one", "self", 50, False), ("élan é", "lan", "é", 9, False), ("x y", "x", "", 9, False), (None, "x", "y", 9, False), ("b a b", "a", "b", 1, True), ("aa", "a", "a", 9, False)]
    for body, a, b, within, want in rows:
        df = spark.createDataFrame([(body, a, b)], "t string, a string, b string")
        assert df.select(texts.own_words_near(F.col("t"), F.col("a"), F.col("b"), within)).first()[0] == want, (body, a, b)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_verbatim(spark, broadcast):
    """Whole quotes at any place, short ones, across line ends, other cases; openings alone are no quote."""
    docs = [(1, "Some words before. The quick\n brown  fox jumps over the lazy dog"), (2, "the quick brown fox jumps over nothing"), (3, "fox"), (4, None), (5, ""), (6, "foxes")]
    quotes = [(10, "the quick brown fox jumps over the lazy"), (20, "FOX"), (30, "  "), (40, None), (50, "brown fox jumps over nothing"), (60, "dog")]
    d, q = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(quotes, "quote long, words string")
    got = {tuple(r) for r in texts.verbatim(d, "doc", "text", q, "quote", "words", broadcast_quotes=broadcast).collect()}
    assert got == {(1, 10), (1, 20), (1, 60), (2, 20), (2, 50), (3, 20)}
    assert texts.verbatim(d, "doc", "text", q.limit(0), "quote", "words").count() == 0


def test_same_names(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("ab ", k=rng.randint(1, 14))).strip() for _ in range(150)} | {"sound shop", "the sound shop", "sound"})
    a, b = names[::2], names[1::2] + ["sound shop"]
    got = {(r.a, r.b) for r in claims.same_names(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in sorted(set(b))], "b string")).collect()}
    inside = lambda x, y: x == y or (len(min(x, y, key=len)) >= 5 and len(x) != len(y) and min(x, y, key=len) in max(x, y, key=len))
    assert got == {(x, y) for x, y in itertools.product(a, set(b)) if x and y and inside(x, y)}


def test_graph_against_all_pairs(spark):
    """Scores from two seeds a node, and threads, are those of all pairs of links."""
    rng = random.Random(9)
    links = {(rng.randrange(40), rng.randrange(12)): rng.choice([0.5, 0.75, 1.0]) for _ in range(200)}
    owner = {a: a % 5 for a in range(40)}
    done = {a: a % 4 for a in range(0, 40, 6)}
    frame = spark.createDataFrame([(a, n, w) for (a, n), w in links.items()], "album long, node long, weight double")
    finished = spark.createDataFrame([(a, s, owner[a]) for a, s in done.items()], "album long, sessions long, owner long")
    owners = spark.createDataFrame([(a, o) for a, o in owner.items() if a not in done], "album long, own long")
    seeds = graph.seed_links(frame, finished)
    import math

    fan = {n: sum(1 for _, m in links if m == n) for _, n in links}
    value = lambda w, sw, n, s: round(w * sw * (1 / (1 + math.log(1 + fan[n] / 10.0))) * min(1.0, 0.5 + 0.1 * s), 4)
    best, threads = {}, {}
    for (a, n), w in links.items():
        for (s, m), sw in links.items():
            if n == m and s in done and a not in done and owner[a] != owner[s]:
                v = value(w, sw, n, done[s])
                best[a, n] = max(best.get((a, n), 0), v)
                threads[s, a] = threads.get((s, a), 0) + v
    got = {(r.album, r.node): r.value for r in graph.node_contributions(frame, seeds, owners).collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 2e-4 for k in best)
    found = {(r.seed, r.album): r.score for r in graph.threads(frame, seeds, owners, 1000).collect()}
    assert found.keys() == threads.keys() and all(abs(found[k] - threads[k]) < 1e-3 for k in threads)


def test_upkeep(spark):
    rows = spark.createDataFrame([(1, "A B", None), (2, "A B", "old"), (3, None, None), (4, "!", None)], "id long, name string, key string")
    made = F.when(F.col("name") == "A B", "ab").otherwise("")
    assert {r.id: r.key for r in upkeep.fill_keys(rows, "name", "key", made).collect()} == {1: "ab", 2: "old", 3: None, 4: "!"}
    renewed = {r.id: (r.key, r.changed) for r in upkeep.renew_keys(rows.where("name = 'A B'"), "name", "key", made).collect()}
    assert renewed == {1: ("ab", True), 2: ("ab", True)}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(upkeep.merged_lists(F.lit("a, NA,b"), F.lit(" b ,c"), F.lit(None))) == "a, b, c"
    assert [one(upkeep.tier(F.lit(n), {5: "core", 20: "wide"}, "deep")) for n in (5, 6, 21)] == ["core", "wide", "deep"]
    assert one(upkeep.clean_genres(F.lit("Jazz (vocal, cool); UK  Bass[x], seen live,!!, lost�"), ["seen live"])) == ["jazz", "uk bass"]
    assert one(upkeep.genre_title(F.lit("uk bass"), ["uk"])) == "UK bass" and one(upkeep.genre_title(F.lit("art pop"), ["uk"])) == "Art pop"
    assert [one(tables.general_number(F.lit(x))) for x in (0.5, 100.0, 1e-7, 1234567.0, 0.0, -2.25, 123456.0)] == ["0.5", "100", "1e-07", "1.23457e+06", "0", "-2.25", "123456"]


def test_variants(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(variants.artist_variants(F.lit("Oto &amp; Bo (UK)"))) == ["Oto & Bo (UK)", "Oto & Bo"]
    assert one(variants.artist_variants(F.lit("音 [Oto] "))) == ["音 [Oto]", "音", "Oto"]
    assert one(variants.title_variants(F.lit("Blue: A Story (1971)"))) == ["Blue: A Story (1971)", "Blue: A Story", "Blue"]
    assert one(variants.title_variants(F.lit("Name (Red One)"), subtitle=False)) == ["Name (Red One)", "Name"]
    assert one(variants.plain_title(F.lit("Left/Right: a [b]!"))) == "Left Right a b" and one(variants.base_album_key(F.lit("name #2001"))) == "name"


def test_entries(spark):
    rows = [("l", 1, "a", "x", 1994), ("l", 2, "a", "x", 1995), ("l", 3, "a", "x", 2001), ("l", 4, "a", "x", None), ("l", 5, "a", "x", 2002), ("l", 6, "", "x", 1), ("m", 7, "a", "x", None), ("l", 8, "b", "x", 1990)]
    got = {(r.list, r.row): r.album_key for r in entries.marked_entries(spark.createDataFrame(rows, "list string, row long, artist_key string, album_key string, year int")).collect()}
    assert got == {("l", 1): "x", ("l", 3): "x #2001", ("m", 7): "x", ("l", 8): "x"}
    asked = spark.createDataFrame([(1, 1999), (2, None), (3, 2000), (4, 1999)], "entry long, year int")
    found = [(1, 10, True, 1980, ["Live"], "Album"), (1, 11, False, 1999, None, "Album"), (2, 20, False, 1990, None, "Album"), (2, 21, False, None, None, "EP"), (4, 40, True, 1999, [], "Album"), (4, 41, True, 2000, [], "Album"), (4, 40, True, 1999, [], "Album")]
    chosen = entries.choose(asked, spark.createDataFrame(found, "entry long, id long, exact boolean, year int, secondary array<string>, kind string"))
    assert {r.entry: (r.status, r.found) for r in chosen.collect()} == {1: ("resolved", [10]), 2: ("resolved", [20]), 3: ("unresolved", []), 4: ("ambiguous", [40, 41])}


def test_search_edges(spark):
    names = spark.createDataFrame([("Neil Young", 9), ("Young Marble", 3), ("O'Neil", 5), (None, 1), ("Xx", 2)], "name string, weight long")
    asked = spark.createDataFrame([("neil",), (" YOUNG ",), ("n",), (None,), ("",), ("eil",), ("xx",)], "asked string")
    got = {}
    for r in search.suggest(asked, names, 3).orderBy("asked", "rank").collect():
        got.setdefault(r.asked, []).append((r.name, r.tier))
    assert got["neil"][0] == ("Neil Young", 1) and ("O'Neil", 3) in got["neil"]
    assert got[" YOUNG "] == [("Young Marble", 1), ("Neil Young", 2)]
    assert got["eil"] == [("Neil Young", 3), ("O'Neil", 3)] and got["xx"] == [("Xx", 1)]
    assert "n" not in got and "" not in got


def test_broken_blocks_cost_only_themselves(spark):
    pages = [(1, '<script type="application/ld+json">{oops</script><script type="application/ld+json">{"@type":"MusicEvent","url":"/shows/9","startDate":"2031-01-01T20:00:00Z","name":"A"}</script>'), (2, None), (3, ""), (4, '<div data-shows="[{&quot;id&quot;:&quot;1&quot;},{&quot;id&quot;:&quot;2&quot;,&quot;starts_at&quot;:&quot;2031-01-01&quot;,&quot;venue&quot;:{&quot;slug&quot;:&quot;v&quot;}}]">'), (5, '<div class="event-card" data-permalink="/other/1">')]
    df = spark.createDataFrame(pages, "page long, html string")
    linked = shows.linked_data(df, "page", "html").collect()
    assert [(r.page, r.source_id, r.title, r.performers) for r in linked] == [(1, "9", "A", [])] and linked[0].starts_at == datetime.datetime(2031, 1, 1, 20)
    assert [(r.page, r.source_id, r.venue_slug) for r in shows.embedded_records(df, "page", "html").collect()] == [(4, "2", "v")]
    assert shows.cards(df, "page", "html").count() == 0
    assert shows.answers(spark.createDataFrame([(1, "{}"), (2, None), (3, "no json")], "page long, body string"), "page", "body").count() == 0
    assert shows.listens(spark.createDataFrame([("{}",), (None,)], "body string"), "body").count() == 0
