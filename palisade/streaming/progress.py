"""Progress events of scans.

Functions without `stream` in their name take batch or streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from palisade import schemas
from palisade.functions import count_bucket
from palisade.operators.common import likely_among
from palisade.operators.dashboard import hour_label, trend_sums
from palisade.operators.findings import dedupe_key, scan_rollup
from palisade.operators.housekeeping import cancel_transitions

TERMINAL = ["scan_complete", "scan_failed"]
KEEP_ALIVE_SECONDS = 300


def read_progress(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """Typed event stream; the number of files per trigger bounds what is in flight."""
    return (
        spark.readStream.schema(schemas.PROGRESS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )


def event_status() -> Column:
    """Status of a scan after an event."""
    kind = F.col("type")
    return F.when(kind == "scan_complete", "completed").when(kind == "scan_failed", "failed").otherwise("running")


def deciding_state() -> Column:
    """Status, percent and time of the first terminal event of a group, else of its latest event."""
    state = F.struct(event_status().alias("status"), "percent", "ts")
    when = F.struct("ts", "event_id")
    ended = F.col("type").isin(TERMINAL)
    return F.coalesce(F.min_by(F.when(ended, state), F.when(ended, when)), F.max_by(state, when))


def latest_status(events: DataFrame) -> DataFrame:
    """Per scan: status, percent, time of the deciding event, number of events.

    The first terminal event decides; without one the latest event does. On a stream (update mode)
    the state is one row per scan and stays; `expiring.ended_scans` keeps those that are active.
    """
    return (
        events.groupBy("scan_id")
        .agg(deciding_state().alias("_s"), F.count("*").alias("n_events"))
        .select("scan_id", "_s.status", "_s.percent", F.col("_s.ts").alias("at"), "n_events")
    )


def stream_dedupe(findings: DataFrame, time_column: str, delay: str) -> DataFrame:
    """Each finding of a stream once, among those no further apart than the watermark delay."""
    keys = [f"_k{i}" for i in range(len(dedupe_key(findings)))]
    return (
        findings.withColumns(dict(zip(keys, dedupe_key(findings))))
        .withWatermark(time_column, delay)
        .dropDuplicatesWithinWatermark(keys)
        .drop(*keys)
    )


def running_counts(events: DataFrame) -> DataFrame:
    """Discovered findings so far per scan and counter (update mode on a stream)."""
    found = events.filter("type = 'finding_discovered'")
    return found.groupBy("scan_id", count_bucket(F.col("severity")).alias("bucket")).agg(
        F.count("*").alias("n")
    )


def running_count_history(events: DataFrame, unit: str = "day") -> DataFrame:
    """For every discovered finding the number so far, by time, per scan and counter.

    Numbers are made in two steps, within a time unit and over the totals of the units before, so
    that a scan with very many events is spread over many tasks.
    """
    found = events.filter("type = 'finding_discovered'").select(
        "event_id", "scan_id", "ts", count_bucket(F.col("severity")).alias("bucket"),
        F.date_trunc(unit, "ts").alias("_unit"),
    )
    keys = ["scan_id", "bucket"]
    before = W.partitionBy(*keys).orderBy("_unit").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        found.groupBy(*keys, "_unit")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = W.partitionBy(*keys, "_unit").orderBy("ts", "event_id")
    return (
        found.withColumn("_within", F.row_number().over(within))
        .join(totals, [*keys, "_unit"])
        .select("event_id", *keys, (F.col("_before") + F.col("_within")).alias("n"))
    )


def sessions(events: DataFrame, seconds: int = KEEP_ALIVE_SECONDS) -> DataFrame:
    """Stretches of a scan without a silence of `seconds`: scan_id, first_ts, last_ts, n.

    Windows that touch are merged, so the gap is one microsecond short of the silence.
    """
    gap = f"{seconds - 1} seconds 999999 microseconds"
    return (
        events.groupBy("scan_id", F.session_window("ts", gap).alias("_w"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
        .select("scan_id", "first_ts", "last_ts", "n")
    )


def idle_periods(events: DataFrame, seconds: int = KEEP_ALIVE_SECONDS, unit: str = "day") -> DataFrame:
    """Silences of at least `seconds` between two events of a scan: scan_id, idle_from, idle_to.

    The event before is found within its time unit, or else is the last of the unit before. Only the
    unit summaries, at most one per scan and unit, meet per scan.
    """
    timed = events.select("scan_id", "ts", F.date_trunc(unit, "ts").alias("_unit"))
    inside = W.partitionBy("scan_id", "_unit").orderBy("ts")
    within = timed.withColumn("_prev", F.lag("ts").over(inside)).filter(F.col("_prev").isNotNull())
    by_unit = W.partitionBy("scan_id").orderBy("_unit")
    across = (
        timed.groupBy("scan_id", "_unit")
        .agg(F.min("ts").alias("ts"), F.max("ts").alias("_last"))
        .withColumn("_prev", F.lag("_last").over(by_unit))
        .filter(F.col("_prev").isNotNull())
    )
    pairs = within.select("scan_id", "_prev", "ts").unionByName(across.select("scan_id", "_prev", "ts"))
    micros = F.timestamp_diff("MICROSECOND", F.col("_prev"), F.col("ts"))
    return pairs.filter(micros >= seconds * 1_000_000).select(
        "scan_id", F.col("_prev").alias("idle_from"), F.col("ts").alias("idle_to")
    )


def alert_rows(completed: DataFrame, base_url: str, min_serious: int = 0) -> DataFrame:
    """Alert per completed scan: target, critical, high, link, message. `completed` has the counters."""
    link = F.concat(F.lit(base_url.rstrip("/") + "/report/"), "scan_id")
    rows = completed.filter(F.col("critical_count") + F.col("high_count") >= min_serious)
    return rows.select(
        "scan_id", "target",
        F.col("critical_count").alias("critical"),
        F.col("high_count").alias("high"),
        link.alias("link"),
        F.format_string(
            "Security alert\nTarget: %s\nCritical: %d\nHigh: %d\n%s", "target", "critical_count", "high_count", link
        ).alias("message"),
    )


def _batch_folder(path: str, batch_id: int) -> str:
    """One folder per micro-batch: a batch that is run again overwrites its own output only."""
    return f"{path.rstrip('/')}/batch={batch_id}"


def finished_rollup(scans: DataFrame, findings: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Counters of the scans of a batch, from their own findings only.

    Rows of other scans are mostly left out before the shuffle. The exact join behind it holds the ids of the batch and
    does not sort the tables, so a task's memory follows the batch and not the stored findings.
    """

    def of(done: DataFrame) -> DataFrame:
        ids = done.select("scan_id").distinct()
        # not a left semi join, which the optimizer would move before the filter
        of_batch = lambda rows: likely_among(rows, ids, ["scan_id"]).join(ids.hint("shuffle_hash"), "scan_id").select(*rows.columns)
        return scan_rollup(of_batch(scans), of_batch(findings))

    return of


def alerts_stream(
    events: DataFrame, scan_table: DataFrame | Callable[[DataFrame], DataFrame], path: str, checkpoint: str, base_url: str, min_serious: int = 0
) -> DataStreamWriter:
    """Write an alert for every scan_complete event. `scan_table` has target and counters, or makes them for the scans of
    a batch (scan_id), such as `finished_rollup`: then no other scan's findings are counted."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = batch.filter("type = 'scan_complete'").select("scan_id").distinct().persist()  # asked several times
        try:
            table = scan_table if isinstance(scan_table, DataFrame) else scan_table(done)
            rows = alert_rows(table.join(done, "scan_id", "left_semi"), base_url, min_serious)
            rows.write.mode("overwrite").parquet(_batch_folder(path, batch_id))
        finally:
            done.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_trend(scans: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Counters of completed scans per hour; `created_at` must be a TIMESTAMP."""
    done = scans.filter("status = 'completed'")
    if scans.isStreaming:
        done = done.withWatermark("created_at", delay)
    return (
        done.groupBy(F.window("created_at", "1 hour").alias("_w"))
        .agg(*trend_sums())
        .select(hour_label(F.col("_w.start")).alias("hour"), "critical", "high", "medium", "low")
    )


def cancel_stream(requests: DataFrame, scan_table: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write the transitions that cancel requests (scan_id, at) cause."""

    def write(batch: DataFrame, batch_id: int) -> None:
        asked = scan_table.join(batch.select("scan_id").distinct(), "scan_id", "left_semi")
        changed = cancel_transitions(asked, batch).filter(F.col("error").isNotNull())
        changed.select("scan_id", "status", "completed_at", "error").write.mode("overwrite").parquet(
            _batch_folder(path, batch_id)
        )

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
