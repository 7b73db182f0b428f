"""Leases as a stateful streaming operator: one holder per key at a time.

A request is granted where the key is free, and then holds it for HOLD seconds at most, so that a holder that dies frees it. A
holder that reports back frees it later still, after a pause: the lock is moved on, never taken away, so whoever looks next sees
that the host has just been asked. The state is one value per key (holder, busy until). A timer at the end of each lease, in
event time, takes the value out, so only keys that are busy at the watermark have state.

Requests of a key are decided in order of time within a batch; batches come in order of arrival. A request that is later than the
watermark is no longer decided. Memory is a key's rows of one batch, whose size the source bounds (files in a batch)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.streaming.runs import folder_of, result, start

PAUSE = 2.0  #: seconds between two requests to a host, at least
HOLD = 60.0  #: seconds after which a lease runs out on its own
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  #: the store that this operator needs
REQUEST, DONE = 1, 0  #: kinds of rows; at one time, reports come before requests

LEASE = "key long, id long, granted boolean, busy_until long"


class Lease(StatefulProcessor):
    """Rows (key, id, kind, at, pause): ``at`` in microseconds, ``pause`` the seconds the key asks for between requests."""

    def __init__(self, hold: float, least_pause: float, strict: bool):
        self.hold, self.least_pause, self.strict = int(hold * 1e6), least_pause, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder long, busy_until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, until = self.lease.get() or (None, None)
        before, at_once = until, {}
        for at, kind, id_, pause in sorted((r.at, r.kind, r.id, r.pause) for r in rows):
            free_at = at + int(max(self.least_pause, pause) * 1e6)
            if kind == DONE:
                if held == id_:
                    until = free_at
                else:
                    at_once[id_] = free_at  # a reading that took no time reports before it is granted
                continue
            if granted := until is None or at > until or (at == until and not self.strict):
                held, until = id_, free_at if at_once.get(id_) == free_at else at + self.hold
            yield Row(key=key[0], id=id_, granted=granted, busy_until=until)
        if until is not None and until != before:
            self.lease.update((held, until))
            self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lease = self.lease.get()
        if lease and lease[1] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:  # else it has been moved on
            self.lease.clear()
        return iter(())

    def close(self) -> None:
        pass


def decisions(rows: DataFrame, hold: float = HOLD, least_pause: float = PAUSE, strict: bool = False, late: str = "10 minutes") -> DataFrame:
    """(key, id, granted, busy_until) for each request of the stream ``rows`` (key, id, kind, at, pause, ts); ``ts`` is ``at`` as a
    timestamp. ``strict``: a lease still holds at the very time it runs out."""
    grouped = rows.withWatermark("ts", late).groupBy("key")
    return grouped.transformWithState(Lease(hold, least_pause, strict), LEASE, "Append", "EventTime")


def start_leases(rows: DataFrame, folder: str, once: bool = True, **terms):
    """Start deciding on the state in ``folder``; a query keeps the state store that it was started with."""
    conf = rows.sparkSession.conf
    was = conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:
        return start(decisions(rows, **terms), folder, "append", once)
    finally:
        conf.set(STORE, was)


def leased(rows: DataFrame, name: str | None = None, **terms) -> DataFrame:
    """Run to the end of the source, going on where the query of that name stopped; all decisions so far."""
    folder = folder_of(rows.sparkSession, name)
    start_leases(rows, folder, **terms).awaitTermination()
    return result(rows.sparkSession, folder, LEASE)
