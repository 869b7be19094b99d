"""Every query with an oracle against DuckDB on the same files; the rest run and keep their own rules."""

import datetime
import decimal
import os

import duckdb
import pytest

from tidemark.functions import keys
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}" if abs(v) < 1e6 else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str([_plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted([_plain(r[columns.index(c)]) for c in sorted(columns)] for r in found.fetchall())
        assert sorted([_plain(r[c]) for c in sorted(columns)] for r in rows) == want


@pytest.mark.parametrize("name, key", [
    ("The Quiet Ones", "quiet ones"), ("Björk", "bjork"), ("A & B", "a and b"), ("One feat. Two", "one"), ("R.E.M.", "rem"), ("  Don’t  Stop ", "dont stop"), ("The", "the"), ("!!!", "!!!"), ("Sigur Rós", "sigur ros"),
])
def test_name_key(name, key):
    assert keys.name_key(name) == key
    assert keys.name_key(key) == key


@pytest.mark.parametrize("title, key", [("Blue (Deluxe Edition)", "blue"), ("Blue - Remastered 2011", "blue"), ("Red (Anna's Version)", "red annas version"), ("Edition", "edition")])
def test_album_key(title, key):
    assert keys.album_key(title) == key


def test_session_bounds(spark):
    """A gap of exactly 30 minutes keeps a session together, a second more splits it; 0.8 is full, three titles of ten partial."""
    from tidemark.operators.sessions import sessions

    at = datetime.datetime(2024, 1, 1)
    step = lambda *seconds: [at + datetime.timedelta(seconds=sum(seconds[: i + 1])) for i in range(len(seconds))]
    rows = [(1, i, t, f"t{i}") for i, t in enumerate(step(0, 1800, 1801))] + [(2, i, t, f"t{i % 8}") for i, t in enumerate(step(*[60] * 9))] + [(3, i, t, f"t{i}") for i, t in enumerate(step(0, 5, 5))]
    df = spark.createDataFrame(rows, "owner int, id int, ts timestamp, title string")
    got = sorted((r.owner, r.listen_count, r.completion, r.session_type) for r in sessions(df, ["owner"], "ts", "id", "title", 1800, 10).collect())
    assert got == [(1, 1, 0.1, "none"), (1, 2, 0.2, "none"), (2, 9, 0.8, "full"), (3, 3, 0.3, "partial")]


def test_streamed_sessions_are_batch_sessions(spark, sf_dir):
    queries = registry.queries()
    batch = {(r.user_id, r.started_at, r.listen_count) for r in queries["album_sessions"](spark, sf_dir).collect()}
    streamed = {(r.user_id, r.started_at, r.n) for r in queries["stream_sessions"](spark, sf_dir).collect()}
    assert streamed and streamed <= batch


def test_sources_and_sinks(spark, tmp_path):
    from tidemark.sources import tables

    (tmp_path / "list.csv").write_text("artist,album,mood\n A , B ,\nC,,calm\n")
    rows = tables.read_csv(spark, str(tmp_path / "list.csv"), ["artist", "album"], ["year"]).collect()
    assert [(r.artist, r.album, r.year, r.facets) for r in rows] == [("A", "B", "", {}), ("C", "", "", {"mood": "calm"})]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "list.csv"), ["none"])
    (tmp_path / "page.md").write_text("---\nurl: http://x\ntitle: T\n---\nBody\n")
    page = tables.read_pages(spark, str(tmp_path / "page.md")).first()
    assert (page.url, page.title, page.body) == ("http://x", "T", "Body\n")
    (tmp_path / "more.csv").write_text("artist,album\nX,Y\n")
    (tmp_path / "registry.csv").write_text("slug,file\none,list.csv\ntwo,more.csv\n")
    listed = tables.read_registry(spark, str(tmp_path / "registry.csv"), str(tmp_path), ["artist", "album"])
    assert sorted((r.slug, r.artist) for r in listed.collect()) == [("one", "A"), ("one", "C"), ("two", "X")]
    (tmp_path / "claims.jsonl").write_text('{"id": 1, "roles": ["a", "b"]}\n{"id": 2}\n')
    assert sorted((r.id, r.roles) for r in tables.read_json_lines(spark, str(tmp_path / "claims.jsonl"), "id int, roles array<string>").collect()) == [(1, ["a", "b"]), (2, None)]
    for refused in ("DROP TABLE x", "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM x", "FROM t INSERT INTO u SELECT *", "SET a = 1", "SELECT reflect('java.lang.System', 'getProperty', 'os.name')", "SELECT 1 WHERE 1 IN (SELECT java_method('java.lang.Math', 'abs', 1))", "SELECT * FROM parquet.`/tmp`", "WITH x AS (SELECT * FROM csv.`/etc`) SELECT * FROM x", "SELECT * FROM nowhere"):
        with pytest.raises(ValueError):
            tables.read_only(spark, refused)
    assert tables.read_only(spark, "SELECT 'a;b' AS x")[0].first().x == "a;b"
    assert tables.read_only(spark, "WITH y AS (SELECT 1 AS x) SELECT max(x) AS x FROM y WHERE x IN (SELECT x FROM y)")[0].first().x == 1
    found, more = tables.read_only(spark, "SELECT * FROM range(5)", 3)
    assert found.count() == 3 and more
