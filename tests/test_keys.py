"""Name keys and line-ups, rule by rule, over names made up for each rule."""

import pytest

from tidemark.functions import keys, lineups


@pytest.mark.parametrize("name, key", [
    ("The Paper Lanterns", "paper lanterns"), ("Zoë Ågren", "zoe agren"), ("Salt & Cedar", "salt and cedar"), ("Mira Vale feat. Oto", "mira vale"), ("Mira Vale (ft Oto)", "mira vale"), ("Mira Vale featuring Oto", "mira vale"),
    ("N.O.W.", "now"), ("Left/Right", "left right"), ("  Can’t   Sleep ", "cant sleep"), ("The", "the"), ("???", "???"), ("€uro", "uro"), ("ひかり", "ひかり"), ("ドレミ・ラボ", "ドレミ ラボ"), ("Unfeatured. Song", "unfeatured song"), ("", ""), ("Großer", "grosser"), ("ﬂow", "flow"),
])
def test_name_key(name, key):
    """Articles, marks, joining signs, guests, dots, apostrophes, scripts; a key is its own key."""
    assert keys.name_key(name) == key
    assert keys.name_key(key) == key


@pytest.mark.parametrize("title, key", [
    ("Harbour (Special Edition)", "harbour"), ("Harbour [1999 Remaster]", "harbour"), ("Harbour – Expanded", "harbour"), ("Harbour (Nell's Version)", "harbour nells version"), ("Harbour (Nell’s Version) [Deluxe]", "harbour nells version"),
    ("Cielo (Versión Completa)", "cielo"), ("Orbit - The 3rd Album", "orbit"), ("Orbit (The 1st Mini Album)", "orbit"), ("Tidal 25th Anniversary Edition", "tidal"), ("25th Anniversary Songs", "25th anniversary songs"),
    ("Harbour LP", "harbour lp"), ("Part One - Rivers", "part one rivers"), ("Tunes feat. Anyone", "tunes feat anyone"), ("Deluxe", "deluxe"),
])
def test_album_key(title, key):
    """Editions and numbered albums go; own versions, formats and guests of albums stay."""
    assert keys.album_key(title) == key


def test_title_keys():
    assert keys.title_key("Lights - 2004 Remaster") == "lights" and keys.title_key("Lights (feat. Oto)") == "lights"
    loose = keys.loose_title_keys
    assert "river part 3" in loose("River (Pt. III)") and "part 2 home" in loose("Part 1: Away / Part 2: Home") and "old road" in loose("Old Road (Live at the Barn)")
    assert "dawn dusk" in loose("Dawn / Dusk - Medley") and "valley" in loose("Valley: Snow - Rain") and "stay" in loose("Stay (with Two Friends)") and "be there" in loose("(I Will) Be There")
    assert loose("") == []


def test_credits():
    assert keys.artist_parts("Ada Moor & The Wires") == ["ada moor", "ada moor and the wires", "wires"]
    assert keys.lead_artist("Ada Moor and The Wires") == "Ada Moor"
    assert keys.split_featured("Ada Moor (feat. Lio & Bey)") == ("Ada Moor", ["Lio", "Bey"])
    assert keys.has_edition("10th anniversary deluxe edition") and not keys.has_edition("Harbour") and not keys.has_edition(None)


def test_primary_artist(spark):
    rows = [("Moor, The Elder", None, None), ("Ada, Bo", ["", " Ada ", "Bo"], None), ("Ada, Bo", None, "Ada"), ("Ada feat. Bo", None, None), ("Ada, Bo", ["Ada ft. Cy"], "Ada"), ("Adam, Bo", [], "Ada"), ("Ada", None, "")]
    df = spark.createDataFrame(rows, "credit string, names array<string>, album string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(keys.primary_artist(F.col("credit"), F.col("names"), F.col("album"))).collect()]
    assert got == ["Moor, The Elder", "Ada", "Ada", "Ada", "Ada", "Adam, Bo", "Ada"]


@pytest.mark.parametrize("title, names", [
    ("Paper Lanterns - A Winter Evening", ["Paper Lanterns"]), ("The Long Road Tour: Mira Vale", ["Mira Vale"]), ("Mira Vale: The Long Road Tour", ["Mira Vale"]), ('Mira Vale "Songs of Snow"', ["Mira Vale"]), ("Salt & Cedar (solo) / Oto", ["Salt & Cedar", "Oto"]),
    ("Oto - Spring 2031 with Bey and Lio", ["Oto", "Bey and Lio"]), ("Ada Moor, The Wide Sky Tour", ["Ada Moor"]), ("Corner Hall presents: Oto w/ Lio, Bey", ["Oto", "Lio", "Bey"]), ("Oto + Lio + Oto", ["Oto", "Lio"]), ('"Quoted Name"', ["Quoted Name"]),
    ("One (open bracket", ["One (open bracket"]), ("", []), ("Oto with Lio with Bey", ["Oto", "Lio with Bey"]),
])
def test_split_lineup(title, names):
    got = lineups.split_lineup(title)
    assert [n.strip('"') for n in got] == names


def test_performers_and_events():
    assert lineups.clean_performer("Oto (solo set)") == ("Oto", "solo set") and lineups.clean_performer("(Little) Oto") == ("(Little) Oto", None) and lineups.clean_performer(" Ada   Moor ") == ("Ada Moor", None)
    assert lineups.clean_performer("Corner Hall Presents Oto") == ("Oto", None) and lineups.clean_performer("(x)") == ("(x)", None)
    events = ["A tribute to Oto", "Oto: the screening", "Space Film IN CONCERT", "40 Years of Oto", '"First" and "Second" by Oto', "The Big Oto Show", "Oto vs. Lio", "Celebrating Oto", "The music of Oto"]
    assert all(map(lineups.non_artist_event, events))
    assert not any(map(lineups.non_artist_event, ["Showroom", 'Oto "First"', "Oto", "Oto vs", "The Show", "A Band, Any Show"]))
