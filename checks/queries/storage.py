"""Removing and closing scans, and batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.operators import housekeeping as ops
from palisade.operators.findings import scan_rollup
from palisade.streaming import progress

c = F.col
ACTIVE = "active AS (SELECT scan_id FROM v_scans WHERE status = 'running' AND length(target) % 2 = 0)"
GONE = "gone AS (SELECT scan_id FROM v_scans WHERE status IN ('completed','failed') OR scan_id NOT IN (SELECT scan_id FROM active))"


def _cleared(t: Inputs):
    active = t.v_scans.filter((c("status") == "running") & (F.length("target") % 2 == 0)).select("scan_id")
    return ops.clear_history(t.v_scans, t.v_findings, active)


@query(f"WITH {ACTIVE}, {GONE} SELECT (SELECT count(*) FROM gone) AS deleted_scans, (SELECT count(*) FROM v_findings WHERE scan_id IN (SELECT scan_id FROM gone)) AS deleted_findings")
def clear_history(t: Inputs):
    return _cleared(t)[2]


@query(f"WITH {ACTIVE}, {GONE} SELECT finding_id FROM v_findings WHERE scan_id NOT IN (SELECT scan_id FROM gone)")
def findings_after_clear(t: Inputs):
    return _cleared(t)[1].select("finding_id")


@query("""SELECT finding_id FROM v_findings WHERE NOT file_path ILIKE '%WALLET%' AND NOT evidence ILIKE '%KEY = 1%' AND scan_id NOT IN (SELECT scan_id FROM v_scans WHERE target ILIKE '%wallet%')""")
def purge_findings(t: Inputs):
    return ops.purge_matching(t.v_scans, t.v_findings, ["%WALLET%"], ["%KEY = 1%"])[1].select("finding_id")


@query("SELECT scan_id FROM v_scans WHERE NOT target ILIKE '%archive1%'")
def purge_scans(t: Inputs):
    return ops.purge_matching(t.v_scans, t.v_findings, ["%Archive1%"], ["%none%"])[0].select("scan_id")


@query("""SELECT scan_id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE status WHEN 'running' THEN '2024-05-01 00:00:00' END AS completed FROM v_scans""")
def fail_orphans(t: Inputs):
    rows = ops.fail_orphans(t.v_scans, "2024-05-01 00:00:00")
    return rows.select("scan_id", "status", c("completed_at").cast("string").alias("completed"))


@query("""WITH asked AS (SELECT CAST(user_id AS STRING) AS scan_id, min(ts) AS at FROM events GROUP BY 1)
SELECT s.scan_id, CASE WHEN a.scan_id IS NOT NULL AND status = 'running' THEN 'failed' ELSE status END AS status,
 CASE WHEN a.scan_id IS NOT NULL AND status = 'running' THEN 'Scan cancelled by user' END AS error FROM v_scans s LEFT JOIN asked a ON a.scan_id = s.scan_id""")
def cancel_transitions(t: Inputs):
    asked = t.events.select(c("user_id").cast("string").alias("scan_id"), c("ts").alias("at"))
    return ops.cancel_transitions(t.v_scans, asked).select("scan_id", "status", "error")


LATEST = """SELECT scan_id, status, percent, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, n AS n_events FROM (
 SELECT scan_id, ts, percent, CASE type WHEN 'scan_complete' THEN 'completed' WHEN 'scan_failed' THEN 'failed' ELSE 'running' END AS status, count(*) OVER (PARTITION BY scan_id) AS n,
  row_number() OVER (PARTITION BY scan_id ORDER BY CASE WHEN type IN ('scan_complete','scan_failed') THEN 0 ELSE 1 END, CASE WHEN type IN ('scan_complete','scan_failed') THEN epoch_us(ts) ELSE -epoch_us(ts) END) AS k FROM v_progress) WHERE k = 1"""
TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query(LATEST)
def latest_status(t: Inputs):
    return progress.latest_status(t.v_progress).withColumn("at", F.date_format("at", TIME))


RUNNING = "SELECT scan_id, CASE WHEN severity IN ('critical','high','medium') THEN severity ELSE 'low' END AS bucket, count(*) AS n FROM v_found_events WHERE type = 'finding_discovered' GROUP BY 1, 2"


@query(RUNNING)
def running_counts(t: Inputs):
    return progress.running_counts(t.v_found_events)


@query("""SELECT event_id, scan_id, CASE WHEN severity IN ('critical','high','medium') THEN severity ELSE 'low' END AS bucket,
 count(*) OVER (PARTITION BY scan_id, CASE WHEN severity IN ('critical','high','medium') THEN severity ELSE 'low' END ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM v_found_events WHERE type = 'finding_discovered'""")
def running_count_history(t: Inputs):
    return progress.running_count_history(t.v_found_events)


GAPS = "g AS (SELECT scan_id, ts, lag(ts) OVER (PARTITION BY scan_id ORDER BY ts) AS prev FROM v_progress)"


@query(f"WITH {GAPS} SELECT scan_id, strftime(prev, '%Y-%m-%d %H:%M:%S.%f') AS idle_from, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS idle_to FROM g WHERE ts - prev >= INTERVAL 300 SECONDS")
def idle_periods(t: Inputs):
    idle = progress.idle_periods(t.v_progress)
    return idle.select("scan_id", *[F.date_format(x, TIME).alias(x) for x in ("idle_from", "idle_to")])


SESSIONS = f"""WITH {GAPS}, s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 300 SECONDS THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY ts) AS no FROM g)
SELECT scan_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, count(*) AS n FROM s GROUP BY scan_id, no"""


@query(SESSIONS)
def sessions(t: Inputs):
    timed = t.v_progress.withColumn("ts", c("ts").cast("timestamp"))
    return progress.sessions(timed).select("scan_id", F.date_format("first_ts", TIME).alias("first_ts"), "n")


ALERTS = """SELECT s.scan_id, s.target, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, 'https://x.example.org/report/' || s.scan_id AS link
 FROM v_scans s LEFT JOIN v_findings f ON f.scan_id = s.scan_id"""


@query(ALERTS + " WHERE s.status = 'completed' GROUP BY 1, 2 HAVING count(*) FILTER (severity IN ('critical','high')) >= 2")
def alert_rows(t: Inputs):
    table = scan_rollup(t.v_scans, t.v_findings).filter("status = 'completed'")
    return progress.alert_rows(table, "https://x.example.org/", 2).drop("message")
