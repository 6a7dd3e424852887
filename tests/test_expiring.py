"""Streams that end: stretches are written once, late events are dropped, and state falls to what is active."""

import datetime as dt

import pytest
from palisade.streaming import expiring

EVENTS = "event_id long, ts timestamp, scan_id string, type string, percent double, severity string"
DAY = dt.datetime(2024, 1, 1)


def event(n, hours, scan, kind="progress", severity=None):
    return (n, DAY + dt.timedelta(hours=hours), scan, kind, float(n), severity)


# five deliveries; scan `a` ends twice, `b` fails, `late` arrives a day late, `c` is active at the end
DELIVERIES = [
    [event(1, 0, "a"), event(2, 1, "a", "finding_discovered", "high"), event(3, 0.5, "b", "scan_failed")],
    [event(4, 1.5, "a", "scan_complete"), event(5, 1.8, "b")],
    [event(6, 10, "a"), event(7, 11, "d", "finding_discovered", "odd")],
    [event(8, 30, "c"), event(9, 30.5, "c")],
    [event(10, 2, "a", "scan_failed"), event(11, 1, "late"), event(12, 31, "c", "finding_discovered", "critical")],
]
WANT = {
    ("a", 0.0, 1.5, 3, "completed", 0, 1, 0, 0), ("b", 0.5, 1.8, 2, "failed", 0, 0, 0, 0), ("a", 10.0, 10.0, 1, "running", 0, 0, 0, 0), ("d", 11.0, 11.0, 1, "running", 0, 0, 0, 1),
}


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    for rows in DELIVERIES:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(str(folder / "out" / f"batch={batch_id}"))

    query = expiring.ended_scans(stream).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(folder / "out")), query.recentProgress


def hours(ts):
    return (ts - DAY).total_seconds() / 3600


def test_ended_once(finished):
    rows = [(r.scan_id, hours(r.first_ts), hours(r.last_ts), r.n_events, r.status, r.critical, r.high, r.medium, r.low) for r in finished[0].collect()]
    assert len(rows) == len(WANT) and set(rows) == WANT


def test_late_events_are_dropped_and_state_falls(finished):
    state = [p.stateOperators[0] for p in finished[1] if p.stateOperators]
    assert sum(s.numRowsDroppedByWatermark for s in state) == 2
    rows = [s.numRowsTotal for s in state]
    assert max(rows) >= 2 and rows[-1] == 1  # only `c` is active


def test_batch_gives_active_ones_too(spark):
    table = spark.createDataFrame([r for rows in DELIVERIES for r in rows], EVENTS)
    got = {(r.scan_id, hours(r.first_ts)): r for r in expiring.ended_scans(table).collect()}
    assert got["c", 30.0].critical == 1 and got["c", 30.0].n_events == 3 and ("late", 1.0) in got
    gaps = expiring.silences(expiring.ended_scans(table)).select("scan_id", "idle_from", "idle_to").collect()
    assert [(g.scan_id, hours(g.idle_from), hours(g.idle_to)) for g in gaps] == [("a", 2.0, 10.0)]
