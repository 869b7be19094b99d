"""Leases on documents as a keyed state machine over a stream of requests: request, start, renew, finish, and lapsed leases swept.

Events may come late, repeated and in any order within the watermark's delay. They are kept until the watermark has passed
them and then applied in the order of their times, so the answer is the same for one batch and for any cut into batches.
A lease that nobody renews lapses by a timer, whether or not another event comes. State is one row of the machine and the
events still waiting, for each document: bounded by what comes within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import run_to_end

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Attempts at one version; a lease's length.
MOST_ATTEMPTS, LEASE_MS = 2, 48 * 3600 * 1000
OUTPUT = "doc long, at timestamp, kind string, accepted boolean, status string, version long, attempts long"
_STATE = "status string, version long, attempts long, holder string, until long, ready long"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class Machine:
    """One document's state. Each step gives whether it was accepted."""

    def __init__(self, status: str = "none", version: int = 0, attempts: int = 0, holder: str | None = None, until: int = 0, ready: int = 0, lease_ms: int = LEASE_MS):
        self.status, self.version, self.attempts, self.holder, self.until, self.ready, self.lease_ms = status, version, attempts, holder, until, ready, lease_ms

    def row(self) -> tuple:
        return self.status, self.version, self.attempts, self.holder, self.until, self.ready

    def _give_up(self) -> None:
        self.status, self.holder, self.until = "requested" if self.attempts < MOST_ATTEMPTS else "failed", None, 0

    def lapse(self, now: int) -> int | None:
        """Sweeps a lease that ended before now: an attempt that failed. Gives when it ended."""
        if self.status != "writing" or self.until >= now:
            return None
        ended = self.until
        self._give_up()
        return ended

    def apply(self, kind: str, holder: str | None, now: int) -> bool:
        if kind == "request":
            if self.status in ("requested", "writing"):
                return False
            self.status, self.version, self.attempts = "requested", self.version + 1, 0
            return True
        if kind == "start":
            if self.status != "requested":
                return False
            self.status, self.attempts, self.holder, self.until = "writing", self.attempts + 1, holder, now + self.lease_ms
            return True
        if self.status != "writing" or holder != self.holder:
            return False
        if kind == "renew":
            self.until = now + self.lease_ms
        elif kind == "ready":
            self.status, self.holder, self.until, self.ready = "ready", None, 0, self.version
        elif kind == "failed":
            self._give_up()
        else:
            return False
        return True


class _Leases(StatefulProcessor):
    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", _STATE)
        # Appended to once a batch and read once a timer: state is called a few times for each document, not for each event.
        self.waiting = handle.getListState("waiting", "at long, kind string, holder string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A repeated event is one.
        new = list({(int(at), kind, holder) for frame in rows for at, kind, holder in zip(frame["ms"], frame["kind"], frame["holder"])})
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0])
        yield pd.DataFrame([], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that is older than the watermark has come: it is applied now, and a timer set for the first event that is not.
        now = timerValues.getCurrentWatermarkInMs() - 1
        machine = Machine(*self.state.get(), lease_ms=self.lease_ms) if self.state.exists() else Machine(lease_ms=self.lease_ms)
        out = []

        def note(at: int, kind: str, accepted: bool) -> None:
            out.append((key[0], datetime.fromtimestamp(at / 1000, timezone.utc).replace(tzinfo=None), kind, accepted, machine.status, machine.version, machine.attempts))

        every = {tuple(k) for k in self.waiting.get()} if self.waiting.exists() else set()
        later = [k for k in every if k[0] > now]
        due = sorted((k for k in every if k[0] <= now), key=lambda k: (k[0], k[1], k[2] or ""))
        for at, kind, holder in due:
            if (ended := machine.lapse(at)) is not None:
                note(ended, "lapse", True)
            note(at, kind, machine.apply(kind, holder, at))
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        if later:
            self.handle.registerTimer(min(later)[0])
        # A timer just behind the lease's end stands for the sweep.
        if (ended := machine.lapse(now)) is not None:
            note(ended, "lapse", True)
        if machine.status == "writing":
            self.handle.registerTimer(machine.until + 1)
        self.state.update(machine.row())
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def transitions(events: DataFrame, late: str, lease_ms: int = LEASE_MS) -> DataFrame:
    """Every event as the machine took it (doc, at, kind, accepted, and status, version, attempts after it), and every lapse.

    events, a stream: doc, at (timestamp), kind (request, start, renew, ready, failed), holder (text; who holds the lease).
    Times count in milliseconds; events of one time are applied by kind, then holder. The state store must be RocksDB:
    spark.sql.streaming.stateStore.providerClass.
    """
    rows = events.select("doc", "at", "kind", F.coalesce("holder", F.lit("")).alias("holder"), F.unix_millis("at").alias("ms"))
    keyed = rows.withWatermark("at", late).groupBy("doc")
    return keyed.transformWithStateInPandas(_Leases(lease_ms), OUTPUT, "append", "EventTime")


def run(spark: SparkSession, events: DataFrame, late: str, lease_ms: int = LEASE_MS) -> DataFrame:
    """All transitions of a stream that is read to its end, with the state store that the machine needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return run_to_end(transitions(events, late, lease_ms))
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
