"""Streams whose state ends: a scan that has been silent for a while is closed, written once, and forgotten.

The watermark decides: state older than it is emitted and dropped, and events that come later than that are left out.
What is kept is one row for each scan that is still active, however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import count_bucket
from palisade.streaming.progress import deciding_state

# The counters of a scan.
COUNT_BUCKETS = ["critical", "high", "medium", "low"]


def ended_scans(events: DataFrame, idle_seconds: int = 7200, delay: str = "2 hours") -> DataFrame:
    """Stretches of activity without a silence of `idle_seconds`, each written when it has ended (append mode): scan_id,
    first_ts, last_ts, n_events, status, percent, at, and the findings discovered in it by counter.

    The first terminal event of a stretch decides its status, else its latest event. `ts` must be a TIMESTAMP. Events
    whose stretch would have ended before the watermark (the latest `ts` less `delay`) are dropped.
    """
    gap = f"{idle_seconds - 1} seconds 999999 microseconds"
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    severity = F.col("severity") if "severity" in events.columns else F.lit(None).cast("string")
    found = F.when(F.col("type") == "finding_discovered", count_bucket(severity))
    return (
        rows.groupBy("scan_id", F.session_window("ts", gap).alias("_w"))
        .agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"),
            deciding_state().alias("_s"), *[F.count_if(found == b).alias(b) for b in COUNT_BUCKETS],
        )
        .select("scan_id", "first_ts", "last_ts", "n_events", "_s.status", "_s.percent", F.col("_s.ts").alias("at"), *COUNT_BUCKETS)
    )


def silences(ended: DataFrame) -> DataFrame:
    """Silences between ended stretches of a scan: scan_id, idle_from, idle_to. Stretches lie apart by the silence that ends
    them, so there are few for a scan in a span of time, however many events it has."""
    before = F.lag("last_ts").over(W.partitionBy("scan_id").orderBy("first_ts"))
    return ended.select("scan_id", before.alias("idle_from"), F.col("first_ts").alias("idle_to")).filter("idle_from is not null")
