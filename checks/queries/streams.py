"""The streaming forms, run over the given tables until all input is read.

Each result must equal that of the batch form, so the SQL is the same.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.queries.storage import ALERTS, LATEST, RUNNING, SESSIONS, TIME
from checks.registry import Inputs, query, with_views
from checks.views import TABLES, VIEWS
from palisade.operators.findings import scan_rollup
from palisade.session import checkpoint_dir, new_path
from palisade.streaming import expiring, progress

c = F.col


def _stream(t: Inputs, table: str, view: str) -> DataFrame:
    """A view whose base table arrives as a stream; its time columns are made TIMESTAMP."""
    base = getattr(t, table)
    source = t.spark.readStream.schema(base.schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)
    name = f"arriving_{uuid.uuid4().hex}"
    source.createOrReplaceTempView(name)
    text = re.sub(rf"\bFROM ({'|'.join(TABLES)})\b", f"FROM {name}", with_views(f"SELECT * FROM {view}"))
    df = t.spark.sql(text)
    for field in df.schema:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, c(field.name).cast("timestamp"))
    return df


def _folder(t: Inputs) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(t: Inputs, df: DataFrame, mode: str) -> DataFrame:
    """All output of a stream, with the number of the micro-batch."""
    folder = _folder(t)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    running = (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The last update of every key."""
    latest = W.partitionBy(*keys).orderBy(c("batch").desc())
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", "batch")


@query(LATEST)
def stream_latest_status(t: Inputs):
    rows = _run(t, progress.latest_status(_stream(t, "events", "v_progress")), "update")
    return _last(rows, "scan_id").withColumn("at", F.date_format("at", TIME))


@query(RUNNING)
def stream_running_counts(t: Inputs):
    rows = _run(t, progress.running_counts(_stream(t, "events", "v_found_events")), "update")
    return _last(rows, "scan_id", "bucket")


@query(SESSIONS)
def stream_sessions(t: Inputs):
    rows = _run(t, progress.sessions(_stream(t, "events", "v_progress")), "complete")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(c("batch") == last).select("scan_id", F.date_format("first_ts", TIME).alias("first_ts"), "n")


# Two in a hundred of the events of the first two fifths come with the last file, days late.
ARRIVING = """a AS (SELECT *, CAST(floor(event_id * 5 / CAST((SELECT count(*) FROM events) AS DOUBLE)) AS INT) AS fifth, event_id % 50 = 0 AS odd FROM v_found_events),
on_time AS (SELECT * FROM a WHERE NOT (odd AND fifth < 2))"""
ENDED = f"""WITH {ARRIVING}, g AS (SELECT *, lag(ts) OVER (PARTITION BY scan_id ORDER BY ts) AS prev FROM on_time),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 2 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY ts) AS no FROM g),
t AS (SELECT *, type IN ('scan_complete', 'scan_failed') AS final FROM s)
SELECT scan_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, count(*) AS n_events,
 CASE coalesce(arg_min(type, ts) FILTER (final), 'none') WHEN 'scan_complete' THEN 'completed' WHEN 'scan_failed' THEN 'failed' ELSE 'running' END AS status,
 count(*) FILTER (type = 'finding_discovered' AND severity = 'critical') AS critical, count(*) FILTER (type = 'finding_discovered' AND severity = 'high') AS high,
 count(*) FILTER (type = 'finding_discovered' AND severity = 'medium') AS medium, count(*) FILTER (type = 'finding_discovered' AND severity NOT IN ('critical', 'high', 'medium')) AS low
FROM t GROUP BY scan_id, no HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) FROM a) - INTERVAL 2 HOURS"""


def _arriving(t: Inputs) -> DataFrame:
    """The events as a stream of six deliveries, the last of them late."""
    path = new_path(t.spark)
    rows = t.sql(f"WITH {ARRIVING} SELECT *, CASE WHEN odd AND fifth < 2 THEN 5 ELSE fifth END AS delivery FROM a").withColumn("ts", c("ts").cast("timestamp"))
    for delivery in range(6):
        rows.filter(c("delivery") == delivery).drop("delivery", "fifth", "odd").repartition(2).write.mode("append").parquet(path)
    schema = t.spark.read.parquet(path).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


@query(ENDED)
def stream_ended_scans(t: Inputs):
    """Closed stretches of activity from a stream with a watermark of two hours; what comes days late is left out."""
    rows = _run(t, expiring.ended_scans(_arriving(t)), "append").drop("batch", "percent", "at")
    return rows.withColumns({n: F.date_format(n, TIME) for n in ("first_ts", "last_ts")})


TREND = """SELECT strftime(created_at, '%Y-%m-%d %H:00') AS hour, sum(critical_count)::BIGINT AS critical, sum(high_count)::BIGINT AS high, sum(medium_count)::BIGINT AS medium, sum(low_count)::BIGINT AS low
FROM v_counted_scans WHERE status = 'completed' GROUP BY 1"""


@query(TREND)
def stream_trend(t: Inputs):
    rows = _run(t, progress.stream_trend(_stream(t, "orders", "v_counted_scans"), "4000 days"), "update")
    return _last(rows, "hour")


@query("SELECT DISTINCT scan_id, rule_id, file_path, line_number, left(evidence, 120) AS evidence_start FROM v_findings")
def stream_dedupe(t: Inputs):
    rows = _run(t, progress.stream_dedupe(_stream(t, "lineitem", "v_findings"), "created_at", "4000 days"), "append")
    return rows.select(
        "scan_id", "rule_id", "file_path", "line_number", F.left("evidence", F.lit(120)).alias("evidence_start")
    )


@query(ALERTS + " WHERE s.scan_id IN (SELECT scan_id FROM v_progress WHERE type = 'scan_complete') GROUP BY 1, 2")
def stream_alerts(t: Inputs):
    folder = _folder(t)
    table = scan_rollup(t.v_scans, t.v_findings)
    writer = progress.alerts_stream(
        _stream(t, "events", "v_progress"), table, f"{folder}/out", f"{folder}/state", "https://x.example.org"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("batch", "message").distinct()


@query(ALERTS + " WHERE s.scan_id IN (SELECT scan_id FROM v_progress WHERE type = 'scan_complete') GROUP BY 1, 2")
def stream_alerts_of_finished(t: Inputs):
    """Alerts whose counters come from the findings of the finished scans alone."""
    folder = _folder(t)
    table = progress.finished_rollup(t.v_scans, t.v_findings)
    writer = progress.alerts_stream(_stream(t, "events", "v_progress"), table, f"{folder}/out", f"{folder}/state", "https://x.example.org")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("batch", "message").distinct()


@query("""SELECT scan_id, 'failed' AS status, 'Scan cancelled by user' AS error FROM v_scans WHERE status = 'running' AND scan_id IN (SELECT CAST(user_id AS STRING) FROM events)""")
def stream_cancellations(t: Inputs):
    folder = _folder(t)
    asked = _stream(t, "events", "v_progress").select("scan_id", c("ts").cast("timestamp_ntz").alias("at"))
    writer = progress.cancel_stream(asked, t.v_scans, f"{folder}/out", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("scan_id", "status", "error").distinct()
