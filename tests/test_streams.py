"""Streams over several batches: the same answer for any cut, with late and repeated events."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import catchup, leases

START = datetime.datetime(2031, 1, 1)
HOUR = datetime.timedelta(hours=1)


def _files(spark, rows, schema, path, cuts):
    """Rows as so many files, each of them one batch; files come in the order of their times."""
    import os
    import time

    each = -(-len(rows) // cuts)
    for i in range(cuts):
        part = rows[i * each : (i + 1) * each]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03}")
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))
    for i, f in enumerate(files):
        os.utime(f, (time.time() - 10_000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def _lease_events():
    rng = random.Random(8)
    rows = []
    for doc in range(12):
        at = START + doc * datetime.timedelta(minutes=7)
        for _ in range(25):
            at += HOUR * rng.choice([1, 5, 20, 60])
            rows.append((doc, at, rng.choice(["request", "request", "start", "start", "renew", "ready", "failed"]), rng.choice("ab")))
    rows.sort(key=lambda r: r[1])
    # Late by up to some hours, and some twice.
    rows = sorted(rows + rng.sample(rows, 40), key=lambda r: r[1] + HOUR * rng.random() * 20)
    return [*rows, (99, START + HOUR * 24 * 400, "request", "a")]


def _expected(rows):
    out = []
    for doc in {r[0] for r in rows if r[0] != 99}:
        machine = leases.Machine()
        note = lambda at, kind, ok: out.append((doc, at, kind, ok, machine.status, machine.version, machine.attempts))  # noqa: E731, B023
        for at, kind, holder in sorted({(int((r[1] - datetime.datetime(1970, 1, 1)).total_seconds() * 1000), r[2], r[3]) for r in rows if r[0] == doc}):
            if (ended := machine.lapse(at)) is not None:
                note(ended, "lapse", True)
            note(at, kind, machine.apply(kind, holder, at))
        if (ended := machine.lapse(10**15)) is not None:
            note(ended, "lapse", True)
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 10])
def test_leases(spark, tmp_path, cuts):
    """Requests, attempts, renewals and lapses by hand-run machines; one batch and ten, late and repeated events."""
    rows = _lease_events()
    stream = _files(spark, rows, "doc long, at timestamp, kind string, holder string", str(tmp_path / "in"), cuts)
    got = sorted((r.doc, r.ms, r.kind, r.accepted, r.status, r.version, r.attempts) for r in leases.run(spark, stream, "2 days").withColumn("ms", F.unix_millis("at")).collect())
    want = _expected(rows)
    assert got == want
    assert {k for _, _, k, ok, *_ in want if ok} == {"request", "start", "renew", "ready", "failed", "lapse"} and {"failed"} <= {s for *_, s, _, _ in want}


def test_machine():
    """The rules, one by one."""
    m = leases.Machine(lease_ms=100)
    assert not m.apply("start", "a", 0) and m.apply("request", None, 0) and not m.apply("request", None, 1)
    assert m.apply("start", "a", 10) and m.row()[:5] == ("writing", 1, 1, "a", 110)
    assert not m.apply("renew", "b", 20) and m.apply("renew", "a", 50) and m.until == 150
    assert m.lapse(150) is None and m.lapse(151) == 150 and m.row()[:3] == ("requested", 1, 1)
    assert m.apply("start", "b", 200) and m.apply("failed", "b", 210) and m.status == "failed"
    assert m.apply("request", None, 300) and m.row()[:3] == ("requested", 2, 0)
    assert m.apply("start", "c", 310) and m.apply("ready", "c", 320) and m.row() == ("ready", 2, 1, None, 0, 2)
    assert not m.apply("ready", "c", 330) and not m.apply("other", "c", 330)


@pytest.mark.parametrize("cuts", [1, 3, 12])
def test_catch_up(spark, tmp_path, cuts):
    """Sessions over any cut, with late events that join two sessions, and with repeated ones; without history they would differ."""
    rng = random.Random(cuts)
    rows = []
    for owner in range(8):
        at = START
        for i in range(60):
            at += datetime.timedelta(minutes=rng.choice([5, 20, 29, 31, 200, 2000]))
            rows.append((owner, at, owner * 1000 + i))
    late = rng.sample(rows, 60)
    order = sorted(rows, key=lambda r: r[1] + (datetime.timedelta(days=9) if r in late else datetime.timedelta(0)))
    order += rng.sample(rows, 20)
    stream = _files(spark, order, "user long, ts timestamp, event long", str(tmp_path / "in"), cuts)
    got = sorted((r.user, r.started_at, r.ended_at, r.n) for r in catchup.keep_sessions(stream, "user", "event", 1800, str(tmp_path / "out")).collect())
    want = []
    for owner in range(8):
        times = sorted(t for o, t, _ in rows if o == owner)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > datetime.timedelta(minutes=30):
                want.append((owner, times[start], times[i - 1], i - start))
                start = i
    assert got == sorted(want)
