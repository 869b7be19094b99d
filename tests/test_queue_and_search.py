"""Queues against a plain builder without the cut, rules of queues one by one, and verification of claims by hand."""

import random
from collections import namedtuple

import pytest

from tidemark.operators import queue, verification

Offer = namedtuple("Offer", "kind lane place item artist")
ARGS = dict(revisit_share=0.4, threads=2, breakers=1, wildcards=1, wild_ranks=(5, 12), seed=3)


def _offers(rng, size):
    kinds = [("pin", "")] * rng.randint(0, 1) + [("revisit", "a"), ("revisit", "b"), ("thread", "x"), ("thread", "y"), ("breaker", ""), ("new", "")]
    out = []
    for kind, lane in kinds:
        for place in range(1, rng.randint(1, size)):
            out.append(Offer(kind, lane, place, rng.randrange(size), rng.randrange(1 + size // rng.choice([2, 20]))))
    return out


@pytest.mark.parametrize("n", [1, 5, 10])
def test_queues_of_cut_offers_are_queues_of_all(spark, n):
    rng = random.Random(n)
    owners = {o: _offers(rng, rng.choice([4, 60, 400])) for o in range(15)}
    rows = [(o, *offer) for o, offers in owners.items() for offer in offers]
    df = spark.createDataFrame(rows, "owner long, kind string, lane string, place long, item long, artist long")
    got = {}
    for r in queue.build_queues(df, n, **ARGS).orderBy("owner", "place").collect():
        got.setdefault(r.owner, []).append((r.slot, r.item, r.artist))
    want = {o: [(s, x.item, x.artist) for s, x in queue.build_one(offers, n, *ARGS.values())] for o, offers in owners.items()}
    assert got == {o: q for o, q in want.items() if q}
    assert queue.build_queues(df.limit(0), n, **ARGS).count() == 0


def test_rules_of_a_queue():
    new = [Offer("new", "", i, 100 + i, i % 7) for i in range(1, 30)]
    build = lambda offers, n, share=0.0, threads=0, breakers=0, wild=0, seed=1: queue.build_one(offers, n, share, threads, breakers, wild, (10, 20), seed)
    plain = build(new, 10)
    assert [o.item for s, o in plain] != [] and len(plain) == 7 and len({o.artist for _, o in plain}) == 7  # one per artist, so seven of ten
    pinned = build([Offer("pin", "", 1, 101, 1), *new], 8, wild=2)
    assert pinned[0][0] == "pinned" and 101 not in [o.item for s, o in pinned[1:]] and "wildcard" not in [s for s, _ in pinned]
    assert any(o.artist == 1 for s, o in pinned[1:])  # a pin blocks no artist
    two = build([Offer("revisit", lane, i, 200 + 10 * k + i, 50 + 10 * k + i) for k, lane in enumerate("ab") for i in range(1, 5)] + new, 8, share=0.5)
    assert sorted(o.item for s, o in two if s == "revisit") == [201, 202, 211, 212]  # two pools in turn
    assert [o.item for s, o in two if s == "new"] == sorted(o.item for s, o in two if s == "new")  # each kind in its own order
    wild = [o for s, o in build(new, 5, wild=2) if s == "wildcard"]
    assert len(wild) == 2 and all(10 <= o.place <= 20 for o in wild)
    assert build(new, 5, wild=2, seed=1) == build(new, 5, wild=2, seed=1)
    assert {s for s, _ in build([Offer("thread", "x", 1, 1, 90), Offer("breaker", "", 1, 2, 91), *new], 5, threads=1, breakers=1)} == {"thread", "tastebreaker", "new"}


END = "struct<type:string,name:string,key:string,artist:string,year:int,of_album:boolean>"
CLAIM = f"claim long, predicate string, source string, extractor string, kind string, basis string, direction string, evidence string, source_url string, album string, subject {END}, object {END}, via string, corroborated array<string>"


def test_verification(spark):
    """Each family of tests on claims of its own."""
    thing = lambda kind, name, artist=None, year=None, of_album=False: (kind, name, name.lower(), artist, year, of_album)

    def claim(n, predicate, subject, object_, kind="text", source="paper", basis="documented", evidence="«as it was»", url="u1", extractor="w", direction="subject_newer", album=None, corroborated=(), via=None):
        return n, predicate, source, extractor, kind, basis, direction, evidence, url, album, subject, object_, via, list(corroborated)

    band, album, person = thing("artist", "The Band Name"), thing("album", "Record"), thing("person", "Some Player")
    claims = [
        claim(1, "member_of", person, band),
        claim(2, "member_of", person, thing("artist", "Band Name"), source="other"),
        claim(3, "member_of", album, band),
        claim(4, "unheard_of", person, band),
        claim(5, "sounds_like", album, band),
        claim(6, "influenced_by", thing("album", "New", year=1990), thing("album", "Newer", year=1999)),
        claim(7, "influenced_by", thing("album", "New", of_album=True), thing("album", "Old", year=1970), album="A1", evidence="as … not there"),
        claim(8, "covers", thing("recording", "Song", "young"), thing("recording", "song", "first")),
        claim(9, "covers", thing("recording", "Song", "first"), thing("recording", "song", "young")),
        claim(10, "credited_on", person, album, kind="extracted", url="u2#x"),
        claim(11, "recorded_at", album, thing("place", "Old Barn Recording Studios"), kind="extracted", url="u2"),
        claim(12, "credited_on", thing("person", "Nobody"), album, kind="extracted", url="u2", evidence="field:role=drums"),
        claim(13, "based_in", band, thing("area", "Town"), kind="map", source="map:1", basis="reported", url="notes#N1.text", evidence="in town"),
        claim(14, "based_in", band, thing("area", "Town"), source="paper", url="u1#a", evidence="as it was", via="v"),
        claim(15, "based_in", band, thing("area", "Town"), kind="owner", source="me", evidence="x", url=None),
        claim(16, "member_of", person, band, source="third", evidence="w" * 301),
    ]
    df = spark.createDataFrame(claims, CLAIM)
    frame = spark.createDataFrame
    types = [("member_of", ["artist", "person"], ["artist"]), ("sounds_like", ["album"], ["artist", "album"]), ("influenced_by", ["album"], ["album"]), ("covers", ["recording"], ["recording"]), ("credited_on", ["person"], ["album"]), ("recorded_at", ["album"], ["place"]), ("based_in", ["artist"], ["area"])]
    found = verification.verify(df, verification.Lookups(
        frame(types, "predicate string, subject_types array<string>, object_types array<string>"),
        frame([("u1", 'Well, "As  it\nwas" [1] so'), ("u2", "some player, at the old barn; role: drums")], "url string, body string"),
        frame([("N1", "They live in Town.", ["u1"])], "note string, text string, cites array<string>"),
        frame([("song", "first", "1960-02"), ("song", "young", "1980")], "work string, artist string, first string"),
        frame([("the band name", "some player")], "band string, person string"),
        frame([("record", "discogs", "some player"), ("record", "musicbrainz", "some player")], "album string, source string, person string"),
        frame([], "type string, key string, year int"), frame([("A1", 1980)], "album string, year int"),
        frame([(1, "SUPPORTS"), (2, "PARTIAL"), (8, "PARTIAL"), (14, "NOT_A_CLAIM")], "claim long, verdict string"),
    ))
    got = {r.claim: (r.fails, r.support, r.confidence, r.status) for r in found.collect()}
    assert got[1] == ([], ["musicbrainz", "other", "third"], 0.95, "accepted")
    assert got[2] == ([], ["paper", "third"], 0.95, "ask")  # the same name, but no database has this one
    assert got[3][0] == ["subject type"] and got[3][3] == "rejected" and got[3][2] == 0.0
    assert got[4][0] == ["unknown predicate"]
    assert got[5][0] == ["must be inferred"]
    assert got[6][0] == ["object is newer"]
    assert got[7][0] == ["quote not in source"]
    assert got[8] == ([], ["musicbrainz"], 0.9, "accepted")
    assert got[9][0] == ["database contradicts", "not the first recording"]
    assert got[10] == ([], ["discogs", "musicbrainz"], 0.95, "accepted")
    assert got[11] == ([], [], 0.75, "accepted")
    assert got[12][0] == ["name not on page"]
    assert got[13] == ([], ["me"], 0.8, "unread")  # the page that the note cites doesn't count
    assert got[14][0] == ["reader rejects"] and got[14][1] == ["me"]
    assert got[15] == ([], ["map:1", "paper:v"], 1.0, "accepted")
    assert got[16][0] == ["evidence too long", "quote not in source"]
    batches = frame([("b1", 1), ("b1", 3), ("b2", 2), ("b2", 1)], "batch string, claim long")
    assert {r.batch: r.settled for r in verification.settled(batches, found).collect()} == {"b1": True, "b2": False}
