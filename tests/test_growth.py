"""Large groups of equal keys: results by plain Python, and rows shuffled that grow with the input, not with its pairs."""

import math
import random
import time

import pandas as pd

from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import catalog, entries, graph, merging, placing, relational
from tidemark.streaming import leases


def _shuffled(spark, run):
    """What run gives, as rows, and how many rows were written to shuffles meanwhile."""

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        none = gateway.jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    rows = run().collect()
    return rows, total() - before


def test_entries_among_many_groups(spark):
    """3,000 groups of few artists and keys, asked for by 400 entries."""
    rng = random.Random(1)
    years = [None, *range(1990, 1999)]
    groups = [(i, i % 2, f"title {i % 3}" if i > 20 else f"rare {i}", i % 11 == 0, rng.choice(years)) for i in range(3000)]
    asked = [(i, f"artist {i % 3}", rng.choice([f"title {i % 4}", f"rare {i % 25}", f"Rare {i % 25}"]), "", "", rng.choice(years)) for i in range(400)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    frames = (
        frame(asked, "entry long, raw_artist string, raw_album string, artist_key string, album_key string, year int"), frame([("artist 2", 0)], "raw_name string, artist int"),
        frame([(0, "artist 0"), (1, "artist 1")], "artist int, key string"), frame(groups, "group_id long, artist int, key string, mapped boolean, year int"),
    )

    def brute(e, last):
        artist = {"artist 0": 0, "artist 1": 1, "artist 2": 0}[e[1]]
        near = [g for g in groups if g[1] == artist and g[2] == e[2].lower() and (g[4] is None or e[5] is None or abs(g[4] - e[5]) <= 1)]
        mapped = [g[0] for g in near if g[3]]
        return mapped[0] if len(mapped) == 1 else near[0][0] if last and not mapped and len(near) == 1 else None

    for last in (False, True):
        rows, shuffled = _shuffled(spark, lambda: entries.find_known(*frames, mapped_only=not last))
        assert {r.entry: r.found for r in rows} == {e[0]: brute(e, last) for e in asked}
        assert shuffled < 12_000
    assert any(brute(e, True) is not None for e in asked)


def test_duplicates_of_one_key(spark):
    """300 entities of one key in many contexts, of which hardly two share one."""
    contexts = [(i, 1000 + i * 20 + j) for i in range(300) for j in range(20)] + [(1, 5), (2, 5), (299, 5), (7, 6), (8, 6), (8, None), (7, None)]
    frames = spark.createDataFrame([(i, "a") for i in range(300)] + [(1, "a"), (500, None)], "id long, k string"), spark.createDataFrame(contexts, "id long, context long")
    rows, shuffled = _shuffled(spark, lambda: graph.duplicate_pairs(frames[0], ["k"], "id", frames[1], "id", "context"))
    assert sorted(map(tuple, rows)) == [(1, 2), (1, 299), (2, 299), (7, 8)]
    assert shuffled < 20_000


def test_either_key_counts(spark):
    """500 rows of two keys each against 500 of the same two; repeated ids on either side count once."""
    left = spark.createDataFrame([(i, 1, 2) for i in range(500)] + [(500, 3, None), (501, None, None), (502, 2, 3), (502, 1, 1), (503, 9, 9)], "l long, a int, b int")
    right = spark.createDataFrame([(i, 1 + i % 2) for i in range(500)] + [(0, 2), (0, 1), (600, 3), (601, None)], "r long, k int")
    rows, shuffled = _shuffled(spark, lambda: relational.either_key_count(left, right, "l", ["a", "b"], "k", "r", "n"))
    assert {r.l: r.n for r in rows} == {i: 500 for i in range(500)} | {500: 1, 502: 501}
    assert shuffled < 10_000


def test_merges_of_many_namesakes(spark):
    """200 loose and 200 firm things of one key; pairs are made at the end only, or not at all."""
    rng = random.Random(2)
    things = [(i, "a", rng.choice(["artist", "person", "x", None]), i % 2 == 0) for i in range(400)]
    shared = [(i, c) for i in range(400) for c in rng.sample(range(400), rng.randint(0, 3))] + [(0, None), (1, None)]
    at = {}
    for i, c in shared:
        at.setdefault(i, set()).add(c) if c is not None else None
    alike = lambda a, b: a is not None and b is not None and (a == b or {a, b} <= {"artist", "person"})
    want = {}
    for i, _, kind, firm in things:
        pairs = [f for f, _, k, is_firm in things if is_firm and alike(kind, k)] if not firm else []
        met = [f for f in pairs if at.get(i, set()) & at.get(f, set())]
        for f in pairs:
            want[i, f] = "none" if not met else "several" if len(met) > 1 else "merge" if f == met[0] else "apart"
    frames = spark.createDataFrame(things, "id long, key string, kind string, firm boolean"), spark.createDataFrame(shared, "id long, context long")
    people = F.col("l.kind").isin("artist", "person") & F.col("f.kind").isin("artist", "person")
    rows, shuffled = _shuffled(spark, lambda: merging.choose_merges(*frames, people))
    assert {(r.loose, r.firm): r.outcome for r in rows} == want and len(rows) == len(want) and set(want.values()) == {"none", "several", "merge", "apart"}
    assert shuffled < 6_000
    rows, shuffled = _shuffled(spark, lambda: merging.chosen_merges(*frames, people))
    assert {tuple(r) for r in rows} == {p for p, outcome in want.items() if outcome == "merge"}
    assert shuffled < 6_000


def test_entries_that_say_the_same(spark):
    """500 entries and 500 known rows of one key, few of which differ; narrowing as row by row."""
    rng = random.Random(3)
    # Of key "b" few are known, so that some entries have one left.
    rows = lambda n: [(i, rng.choice("aaaaab"), rng.choice([None, *range(1990, 1994)]), rng.choice([None, "x", "y"])) for i in range(n)]
    asked, known = rows(500), [r for r in rows(500) if r[1] == "a" or r[0] < 25]
    want = {}
    for e in asked:
        left = [k for k in known if k[1] == e[1]]
        for keep in (lambda k: k[2] is not None and e[2] is not None and abs(k[2] - e[2]) <= 1, lambda k: k[3] is not None and k[3] == e[3]):
            left = [k for k in left if keep(k)] or left
        want[e[0]] = left[0][0] if len(left) == 1 else None
    frames = spark.createDataFrame(asked, "entry long, key string, year int, kind string"), spark.createDataFrame(known, "id long, key string, k_year int, k_kind string")
    conditions = [F.abs(F.col("year") - F.col("k_year")) <= 1, F.col("kind") == F.col("k_kind")]
    got, shuffled = _shuffled(spark, lambda: catalog.resolve_entries(*frames, ["key"], conditions))
    assert {r.entry: r.found for r in got} == want and any(want.values())
    assert shuffled < 5_000


def test_genre_of_week_reads_what_was_heard(spark, sf_dir):
    """what was heard comes from the lines again, not from the genres' own rows."""
    from tidemark.plans.registry import queries

    assert "lineitem.parquet" in " ".join(queries()["genre_of_week"](spark, sf_dir).inputFiles())


def test_nearest_in_a_crowd(spark, monkeypatch):
    """3,000 places within 150 m, some of them twice: looked in by small cells first; a few rows find theirs further off."""
    rng = random.Random(4)
    b = [(i, 40 + rng.random() / 1500, -80 + rng.random() / 1500) for i in range(3000)]
    b += [(5000 - i, *b[i][1:]) for i in range(50)] + [(9000, 41.0, 179.9999), (9001, 50.0, 3.0)]
    a = [(i, 40 + rng.random() / 1000, -80 + rng.random() / 1000) for i in range(40)] + [(100, *b[7][1:]), (101, 41.0, -179.9999), (102, 50.001, 3.0), (103, 50.002, 3.0)]

    def metres(p, q):
        apart = (q[2] - p[2] + 180) % 360 - 180
        return 6_371_000.0 * math.hypot(math.radians(apart) * math.cos(math.radians((p[1] + q[1]) / 2)), math.radians(q[1] - p[1]))

    best = {p[0]: min((metres(p, q), q[0]) for q in b) for p in a}
    looked = []
    within = relational._within
    monkeypatch.setattr(relational, "_within", lambda *args: looked.append(args[2]) or within(*args))
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} long, lat double, lon double")
    got = {r.a: (r.b, round(r.metres, 3)) for r in relational.nearest_within(frame(a, "a"), frame(b, "b"), 150, "a", "b").collect()}
    assert got == {k: (i, round(m, 3)) for k, (m, i) in best.items() if m <= 150} and {100, 101, 102} <= set(got) and 103 not in got
    assert looked[0] < 20 and looked[-1] == 150


def test_leases_call_state_by_batch(spark):
    """a batch of many events of one document is one append and one timer; what is due leaves the state at once."""
    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendList", "put"):
                    self.held = (self.held if name == "appendList" else []) + list(args[0])
                if name == "clear":
                    self.held = []
                if name == "exists":
                    return bool(self.held)
                if name == "get":
                    return iter(self.held)
                if name == "update":
                    self.row = args[0]

            return call

    class Handle:
        timers = []

        def getValueState(self, *_):
            return State()

        getListState = getMapState = getValueState

        def registerTimer(self, at):
            calls.append("registerTimer")
            self.timers.append(at)

    leases_of = leases._Leases(10**9)
    leases_of.init(Handle())
    frame = pd.DataFrame({"ms": [*range(500, 1000), *range(500, 1000)], "kind": ["request", "start"] * 500, "holder": ["h"] * 1000})
    list(leases_of.handleInputRows((1,), iter([frame]), None))
    assert len(calls) == 2 and Handle.timers == [500]
    now = type("T", (), {"getCurrentWatermarkInMs": lambda self: 900})()
    out = next(leases_of.handleExpiredTimer((1,), now, None))
    assert list(out["kind"][:2]) == ["request", "start"] and len(out) == 400
    assert len(leases_of.waiting.held) == 100 and Handle.timers[1] == 900 and len(calls) < 12


def test_album_briefs_send_lines_once(spark, sf_dir):
    """lines are not expanded, once for each distinct count, before they are gathered by album."""
    from tidemark.plans.registry import queries

    plan = queries()["album_briefs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Expand" not in plan


def test_runs_among_many_groups(spark, monkeypatch):
    """Runs and groups of few blocks; cells are small, so that runs, groups and pairs are parted; repeated plays, null titles."""
    for name, n in (("CELL_PLAYS", 200), ("CELL_ENTRIES", 1500), ("CELL_PAIRS", 400)):
        monkeypatch.setattr(placing, name, n)
    rng = random.Random(6)
    titles = [f"t{i}" for i in range(12)]
    loose = lambda t: [f"own {t}", f"half {int(t[1:]) // 2}"] if t else ["half 1"]
    runs = [(r, r % 2, r % 5) for r in range(300)]
    groups = [(g, g % 2, g % 5, g % 3 == 0, rng.choice([2, 3, 4])) for g in range(120)]
    some = lambda odd: rng.choice([None, "r1", "r2", "r3"]) if odd else None
    plays = [(r, r * 10 + i, some(i % 2), rng.choice(titles[:6] if r % 3 else titles) if i else rng.choice([None, "t1", "t2"]), rng.choice([None, *range(r % 2, 120, 2)])) for r, _, _ in runs for i in range(rng.randint(1, 5))]
    plays += [(7, 70, "r2", "t3", 5), (9, 90, None, "t4", None)]  # one play twice, with another title
    tracks = [(g[0], i, some(i % 3), rng.choice(titles[:8]) if i % 4 else f"other {i}") for g in groups for i in range(rng.randint(2, 9))]
    lists = {}
    for g, i, recording, title in tracks:
        on = lists.setdefault(g, {})
        for tier, key in ((1, recording), (2, title), *((3, k) for k in (loose(title) if title in titles else [title]))):
            if key is not None:
                on.setdefault((tier, key), []).append((i, title))
    found = {}
    for run, play, recording, title, _ in plays:
        for g in groups:
            if g[1] == run % 2:
                on = lists[g[0]]
                met = [(t, -len(k), k, min(on[t, k])[0], title) for t, k in ((1, recording), (2, title), *((3, k) for k in loose(title))) if (t, k) in on and (t < 3 or len({x for _, x in on[t, k]}) == 1)]
                least = lambda m: (*m[:4], m[4] is not None, m[4] or "")
                if met:
                    have = found.get((run, g[0], play))
                    found[run, g[0], play] = min([*met, *([have] if have else [])], key=least)
    want = {}
    for run, block, key in runs:
        own = [p for p in plays if p[0] == run]
        n, scores = len({p[3] for p in own} - {None}), []
        for g, b, k, whole, size in groups:
            heard = {p[1]: found[run, g, p[1]] for p in own if (run, g, p[1]) in found}
            got = len({m[4] for m in heard.values()} - {None})
            if b == block and heard and got >= 0.8 * n and (not whole or len({m[3] for m in heard.values()}) >= 0.8 * size):
                scores.append(((got, k == key, sum(m[0] == 1 for m in heard.values()), len({p[1] for p in own if p[4] == g})), g, sorted(heard)))
        top = [s for s in scores if s[0] == max(scores)[0]]
        if len(top) == 1:
            want[run] = (top[0][1], top[0][0][0], top[0][2])
    play = spark.createDataFrame([(*p[:4], loose(p[3]), p[4]) for p in plays], "run long, play long, recording string, title string, loose array<string>, held long")
    track = spark.createDataFrame([(*t, loose(t[3]) if t[3] in titles else [t[3]]) for t in tracks], "group_id long, position long, recording string, title string, loose array<string>")
    group = spark.createDataFrame(groups, "group_id long, block long, key long, whole boolean, track_count long")
    blocks = placing.Blocks(spark.createDataFrame(runs, "run long, block long, key long"), group.select("block", "group_id", "key"))
    rows, shuffled = _shuffled(spark, lambda: placing.track_positions(play, track, blocks))
    assert {(r.run, r.group_id, r.play): (r.tier, r.position, r.title) for r in rows} == {k: (m[0], m[3], m[4]) for k, m in found.items()} and len(rows) == len(found) > 20_000
    assert shuffled < 20_000
    sizes = group.select("group_id", "whole", "track_count")
    rows, shuffled = _shuffled(spark, lambda: placing.place_runs(play, track, blocks, sizes))
    assert {r.run: (r.group_id, r.titles, r.placed) for r in rows} == want and len(want) > 20
    assert any(groups[g][3] for g, _, _ in want.values())
    # A row for each pair as candidates gives the same.
    pairs = blocks.runs.join(blocks.groups.withColumnRenamed("key", "k"), "block").select("run", "group_id", (F.col("key") == F.col("k")).alias("exact"))
    assert {r.run: (r.group_id, r.titles, r.placed) for r in placing.place_runs(play, track, pairs, sizes).collect()} == want


def _plays_told_often(spark):
    """600 runs of one play each, told three times with titles and recordings of some 30: nearly as many sets of them as plays."""
    rng = random.Random(21)
    asks = [(f"r{i}" if i % 3 else None, f"t{i}") for i in range(30)]
    plays = [(r, r, *a) for r in range(600) for a in rng.sample(asks, 3)]
    lists = {g: {rng.choice(asks): i for i in range(12)} for g in range(100)}
    found = {}
    for r, _, recording, title in plays:
        for g, on in lists.items():
            for (other, t), i in on.items():
                tier = 1 if recording and recording == other else 2 if title == t else None
                key = recording if tier == 1 else title
                if tier and (tier, -len(key), key) < found.get((r, g), (9,))[:3]:
                    found[r, g] = (tier, -len(key), key, i, title)
    play = spark.createDataFrame([(*p, [], None) for p in plays], "run long, play long, recording string, title string, loose array<string>, held long")
    track = spark.createDataFrame([(g, i, *a, []) for g, on in lists.items() for a, i in on.items()], "group_id long, position long, recording string, title string, loose array<string>")
    blocks = placing.Blocks(spark.range(600).selectExpr("id AS run", "0 AS block", "id % 50 AS key"), spark.range(100).selectExpr("0 AS block", "id AS group_id", "id % 50 AS key"))
    return play, track, blocks, found


def test_runs_of_plays_told_often(spark):
    """what is looked up grows with different titles, not with the sets of them that plays have."""
    play, track, blocks, found = _plays_told_often(spark)
    groups = spark.range(100).selectExpr("id AS group_id", "false AS whole", "1 AS track_count")
    rows, shuffled = _shuffled(spark, lambda: placing.place_runs(play, track, blocks, groups, share=0.3))
    want = {}
    for r in range(600):
        scores = [((g % 50 == r % 50, found[r, g][0] == 1), g) for g in range(100) if (r, g) in found]
        top = [g for score, g in scores if score == max(scores)[0]]
        if len(top) == 1:
            want[r] = (top[0], 1, [r])
    assert {r.run: (r.group_id, r.titles, r.placed) for r in rows} == want and len(want) > 20
    assert shuffled < 15_000 < len(found)


def test_moves_of_plays_told_often(spark):
    """the placement applied to listens costs no more rows than listens and placed plays."""
    play, track, blocks, _ = _plays_told_often(spark)
    groups = spark.range(100).selectExpr("id AS group_id", "false AS whole", "1 AS track_count")
    listens = spark.range(600).selectExpr("id AS listen", "id % 100 AS group_id", "CASE WHEN id % 2 = 0 THEN 'run' END AS placed_by")
    placed = {r.run: r.group_id for r in placing.place_runs(play, track, blocks, groups, share=0.3).collect()}
    rows, shuffled = _shuffled(spark, lambda: placing.apply_placement(listens, placing.place_runs(play, track, blocks, groups, share=0.3).select("group_id", F.explode("placed").alias("listen"))))
    assert {r.listen: (r.group_id, r.moved, r.released) for r in rows} == {i: (placed.get(i, i % 100), placed.get(i, i % 100) != i % 100, i not in placed and i % 2 == 0) for i in range(600)}
    assert shuffled < 17_000


def test_positions_of_plays_told_often(spark, monkeypatch):
    """found places are neither shuffled nor held, also where a play is told in two batches of a cell; chunks, few pairs at once."""
    for name, n in (("CELL_ENTRIES", 500), ("CELL_PAIRS", 300)):
        monkeypatch.setattr(placing, name, n)
    play, track, blocks, found = _plays_told_often(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows, shuffled = _shuffled(spark, lambda: placing.track_positions(play, track, blocks))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.run, r.group_id): (r.tier, r.position, r.title) for r in rows} == {k: (m[0], *m[3:]) for k, m in found.items()} and len(rows) == len(found)
    assert shuffled < 20_000 < len(found)


def test_loose_homes_find_keys_by_title(spark, sf_dir, monkeypatch):
    """keys are found once for each different title, not for each line of each use."""
    from tidemark.functions import keys
    from tidemark.plans.registry import queries

    found = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def counted(names: pd.Series) -> pd.Series:
        found.add(len(names))
        return names.map(keys.loose_title_keys)

    monkeypatch.setattr(keys, "loose_title_keys_udf", counted)
    _, shuffled = _shuffled(spark, lambda: queries()["overlap_loose_homes"](spark, sf_dir))
    titles = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().count()
    assert 0 < found.value <= 3 * titles
    assert shuffled < 20 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_own_words_that_stand_often(spark):
    """two words that stand 20,000 times each, too far apart until the last; each text is read once."""
    far = "one " * 20_000 + "x" * 200 + " two" * 20_000
    docs = spark.createDataFrame([(far, "one", "two", False), (far + " " * 150 + "one", "one", "two", True), (far + " " * 151 + "one", "one", "two", False)], "t string, a string, b string, want boolean")
    began = time.time()
    assert all(r[0] == r[1] for r in docs.select(texts.own_words_near(F.col("t"), F.col("a"), F.col("b"), 150), "want").collect())
    assert time.time() - began < 20


def test_sources_are_counted_where_dealt(spark, monkeypatch):
    """claims are not gathered before they are dealt out, and more of them make more tasks, not larger ones."""
    monkeypatch.setattr(graph, "CLAIMS_PER_TASK", 1000)
    rng = random.Random(8)
    rows = [(rng.randrange(3000), rng.choice([None, "a", "b"]), rng.choice([None, *range(5)])) for _ in range(20_000)]
    want = {}
    for a, b, source in rows:
        want.setdefault((a, b), set()).add(source)
    df = graph.distinct_sources(spark.createDataFrame(rows, "a long, b string, source long"), ["a", "b"], "source")
    assert {(r.a, r.b): r.n for r in df.collect()} == {k: len(v - {None}) for k, v in want.items()}
    assert df.rdd.getNumPartitions() == 20
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan[plan.index("Exchange") :]


def test_pieces_of_one_text(spark, monkeypatch):
    """many pieces of one page are looked up together, and found as `in` finds them."""
    monkeypatch.setattr(texts, "PIECES_PER_TASK", 100)
    rng = random.Random(9)
    body = "".join(rng.choices("ab é😀 c", k=4000)) + "words of 12345 as written"
    pieces = {body[i : i + n] for i in range(0, 3900, 13) for n in (1, 2, 3, 5, 8, 15, 16, 17, 40)} | {"".join(rng.choices("ab é😀 c", k=rng.randint(1, 30))) for _ in range(500)} | {body, body + "x", "words of 12345", "words of 12346"}
    want = {x for x in pieces if x in body}
    monkeypatch.setattr(texts, "PLAIN_SEARCH", 0)
    assert {x for x, held in zip(sorted(pieces), texts.contained(body, sorted(pieces))) if held} == want
    monkeypatch.undo()
    monkeypatch.setattr(texts, "PIECES_PER_TASK", 100)
    asked = spark.createDataFrame([("p", x) for x in pieces] + [("q", "a"), (None, "a"), ("p", None)], "at string, piece string")
    got = texts.held_pieces(asked, spark.createDataFrame([("p", body), ("r", "a"), ("q", None)], "at string, body string")).collect()
    assert sorted(r.piece for r in got) == sorted(want)
    lines = [f"words of {i} as written" for i in range(100_000)]
    began = time.time()
    assert texts.contained("\n".join(lines), lines[::2] + ["words of 100000 as"]) == [True] * 50_000 + [False]
    assert time.time() - began < 30


def test_threads_shuffle_no_pairs(spark, monkeypatch):
    """F16: some 40,000 pairs of seed and album through 20 nodes, in several blocks and lists, without any broadcast."""
    rng = random.Random(16)
    links = {(a, n): rng.choice([0.5, 0.75, 1.0]) for n in range(20) for a in rng.sample(range(600), 200)}
    done = {a: a % 4 for a in range(0, 600, 6)}
    frame = spark.createDataFrame([(a, n, w) for (a, n), w in links.items()], "album long, node long, weight double")
    finished = spark.createDataFrame([(a, s, a // 6 % 3) for a, s in done.items()], "album long, sessions long, owner long")
    owners = spark.createDataFrame([(a, a // 6 % 3) for a in range(600) if a not in done], "album long, own long")
    for limit, value in {"BROADCAST_SEEDS": 0, "PAIRS_PER_BLOCK": 8000, "LIST_ALBUMS": 60}.items():
        monkeypatch.setattr(graph, limit, value, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, shuffled = _shuffled(spark, lambda: graph.threads(frame, graph.seed_links(frame, finished), owners, 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scores = {}
    for (a, n), w in links.items():
        for s in done:
            if a not in done and (s, n) in links and a // 6 % 3 != s // 6 % 3:
                value = round(w * links[s, n] / (1 + math.log(1 + 200 / 10)) * min(1.0, 0.5 + 0.1 * done[s]), 4)
                scores.setdefault(s, {}).setdefault(a, []).append(value)
    best = {s: sorted((-round(sum(v), 4), a) for a, v in of.items())[:3] for s, of in scores.items()}
    assert sorted((r.seed, r.rank, r.album) for r in rows) == sorted((s, i + 1, a) for s, top in best.items() for i, (_, a) in enumerate(top))
    # The pairs of seed and album alone would be more rows.
    assert shuffled < sum(map(len, scores.values()))
