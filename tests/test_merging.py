"""Merges by plain Python: chains, choices, what moves, and the way back."""

import random

import pytest

from tidemark.operators import merging

THINGS, CLAIMS, LINKS = "id long, name string", "claim long, subject long, object long, context long, predicate string, source string, status string", "id long, url string, kind string"


def _map(df):
    return {r.old_id: r.new_id for r in df.collect()}


def _end(pairs, gone):
    while gone in pairs:
        gone = pairs[gone]
    return gone


@pytest.mark.parametrize("seed", range(2))
def test_closure(spark, seed):
    """A long chain, a wide star and random trees; of two rows of one id the least counts; nulls and self pairs are ignored."""
    rng = random.Random(seed)
    pairs = {i: i - 1 for i in range(2, 200)} | {1000 + i: 1000 for i in range(1, 300)} | {5000 + i: 5000 + rng.randint(0, i - 1) for i in range(1, 200)}
    rows = [*pairs.items(), (7, 6000), (None, 3), (4, None), (1, 1)]
    got = _map(merging.closure(spark.createDataFrame(rows, "gone long, keep long")))
    assert got == {k: _end(pairs, k) for k in pairs}
    assert _map(merging.closure(spark.createDataFrame([], "gone long, keep long"))) == {}


@pytest.mark.parametrize("n", [2, 3, 5])
def test_closure_refuses_cycles(spark, n):
    with pytest.raises(ValueError):
        merging.closure(spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(50, 0)], "gone long, keep long"))


def test_choices(spark):
    things = spark.createDataFrame([(1, "a", "artist", True), (2, "a", "person", False), (3, "a", "artist", False), (4, "a", "place", False), (5, "b", "x", True), (6, "b", "x", True), (7, "b", "x", False), (8, "c", "x", False)], "id long, key string, kind string, firm boolean")
    shared = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (5, 20), (6, 20), (6, 21), (7, 20), (7, 20)], "id long, context long")
    from pyspark.sql import functions as F

    people = F.col("l.kind").isin("artist", "person") & F.col("f.kind").isin("artist", "person")
    got = {(r.loose, r.firm): r.outcome for r in merging.choose_merges(things, shared, people).collect()}
    assert got == {(2, 1): "merge", (3, 1): "none", (7, 5): "several", (7, 6): "several"}
    only = {(r.loose, r.firm): r.outcome for r in merging.choose_merges(things, shared.where("id <> 5"), people).collect()}
    assert only[(7, 6)] == "merge" and only[(7, 5)] == "apart"


def _data(spark, seed):
    rng = random.Random(seed)
    things = [(i, f"n{i}") for i in range(40)]
    claims = [(c, rng.randrange(40), rng.choice([None, *range(40)]), rng.choice([None, *range(40)]), rng.choice("pq"), rng.choice("st"), rng.choice(["proposed", "accepted"])) for c in range(300)]
    links = sorted({(rng.randrange(40), f"u{rng.randrange(9)}", "k") for _ in range(80)})
    mapping = {i: rng.randrange(10) for i in range(10, 40) if rng.random() < 0.6}
    frames = [spark.createDataFrame(r, s) for r, s in ((things, THINGS), (claims, CLAIMS), (links, LINKS), (list(mapping.items()), "old_id long, new_id long"))]
    return things, claims, links, mapping, frames


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_apply_and_undo(spark, seed):
    things, claims, links, mapping, frames = _data(spark, seed)
    merged = merging.apply_merges(*frames)
    to = lambda i: mapping.get(i, i)
    said, want = {}, []
    for c in claims:
        moved = c[1] in mapping or c[2] in mapping
        said.setdefault((to(c[1]), to(c[2]), c[4], c[5]), []).append((moved, c[0]))
    for c in claims:
        same = said[(to(c[1]), to(c[2]), c[4], c[5])]
        moved = c[1] in mapping or c[2] in mapping
        want.append((c[0], to(c[1]), to(c[2]), to(c[3]), c[4], c[5], "superseded" if moved and c[0] != min(same)[1] else c[6]))
    assert _rows(merged.claims) == sorted(want, key=repr)
    assert _rows(merged.things) == sorted([t for t in things if t[0] not in mapping], key=repr)
    assert _rows(merged.links) == sorted({(to(i), u, k) for i, u, k in links}, key=repr)
    back = merging.undo_merges(merged)
    assert (_rows(back.things), _rows(back.claims), _rows(back.links)) == tuple(sorted(x, key=repr) for x in (things, claims, links))
    assert back.log.count() == 0


def test_undo_of_some(spark):
    """One of two merges into one thing is taken back: only its own claims and links go with it."""
    frames = [spark.createDataFrame(r, s) for r, s in (
        ([(1, "firm"), (2, "two"), (3, "three")], THINGS),
        ([(10, 2, None, None, "p", "s", "proposed"), (11, 3, 2, 2, "p", "s", "proposed"), (12, 3, None, None, "p", "s", "accepted")], CLAIMS),
        ([(2, "both", "k"), (3, "both", "k"), (3, "own", "k")], LINKS), ([(2, 1), (3, 1)], "old_id long, new_id long"),
    )]
    merged = merging.apply_merges(*frames)
    assert {r.claim: r.status for r in merged.claims.collect()} == {10: "proposed", 11: "proposed", 12: "superseded"}
    back = merging.undo_merges(merged, spark.createDataFrame([(3,)], "old_id long"))
    assert _rows(back.things) == [(1, "firm"), (3, "three")]
    assert _rows(back.claims.select("claim", "subject", "object", "status")) == [(10, 1, None, "proposed"), (11, 3, 1, "proposed"), (12, 3, None, "accepted")]
    assert _rows(back.links) == [(1, "both", "k"), (3, "both", "k"), (3, "own", "k")]
    assert {r.old_id for r in back.log.where("what <> 'arrived'").collect()} == {2}


def test_move_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, x string")
    assert _rows(merging.move_rows(rows, spark.createDataFrame([(2, 1)], "old_id long, new_id long"), "id")) == [(1, "a"), (1, "b"), (None, "c")]
