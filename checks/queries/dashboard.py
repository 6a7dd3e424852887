"""Roll-ups over stored scans and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.operators import dashboard as ops
from palisade.operators import findings as stored

c = F.col
ROLLUP = """
WITH r AS (SELECT s.scan_id, s.status, s.created_at, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity IN ('low','info')) AS low
FROM v_scans s LEFT JOIN v_findings f ON f.scan_id = s.scan_id GROUP BY s.scan_id, s.status, s.created_at)
"""


@query("""SELECT scan_id, target, status, CAST(created_at AS VARCHAR) AS created FROM v_scans ORDER BY created_at DESC, scan_id LIMIT 20 OFFSET 40""")
def list_scans(t: Inputs):
    page = stored.list_scans(t.v_scans, skip=40, limit=20)
    return page.select("scan_id", "target", "status", c("created_at").cast("string").alias("created"))


@query("""
WITH k AS (SELECT * FROM v_findings WHERE severity = 'critical' AND category = 'secret')
SELECT finding_id, (SELECT count(*) FROM k) AS total FROM (SELECT * FROM k ORDER BY created_at DESC, finding_id LIMIT 25 OFFSET 50)""")
def page_findings(t: Inputs):
    total, page = stored.page_findings(t.v_findings, page=3, per_page=25, severity="critical", category="secret")
    return page.select("finding_id", F.lit(total).cast("bigint").alias("total"))


@query("""SELECT scan_id, target, status FROM v_scans WHERE scan_id = (SELECT max(scan_id) FROM v_scans)""")
def get_scan(t: Inputs):
    last = t.v_scans.agg(F.max("scan_id")).first()[0]
    return stored.get_scan(t.v_scans, last).select("scan_id", "target", "status")


@query("""SELECT s.severity, count(f.finding_id) AS n FROM (SELECT unnest(['critical','high','medium','low','info']) AS severity) s
LEFT JOIN v_findings f ON f.severity = s.severity GROUP BY 1""")
def severity_counts(t: Inputs):
    return ops.severity_counts(t.v_findings)


@query("""SELECT severity, count(*) AS n, round(count(*) / (SELECT count(*) FROM v_findings)::DOUBLE, 6) AS share,
 floor(100 * count(*) / (SELECT count(*) FROM v_findings)::DOUBLE + 0.5)::BIGINT AS percent FROM v_findings GROUP BY 1""")
def severity_share(t: Inputs):
    return ops.severity_share(t.v_findings)


@query("SELECT category, count(*) AS n FROM v_findings GROUP BY 1")
def category_counts(t: Inputs):
    return ops.category_counts(t.v_findings)


@query("SELECT (SELECT count(*) FROM v_scans) AS total_scans, (SELECT count(*) FROM v_findings) AS total_findings")
def dashboard_totals(t: Inputs):
    return ops.dashboard_totals(t.v_scans, t.v_findings)


@query("SELECT scan_id, target FROM v_scans ORDER BY created_at DESC, scan_id LIMIT 10")
def recent_scans(t: Inputs):
    return ops.recent_scans(t.v_scans).select("scan_id", "target")


@query("""SELECT rule_id, title, severity, category, count(*) AS n FROM v_findings GROUP BY ALL ORDER BY n DESC, rule_id, title, severity, category LIMIT 5""")
def top_vulnerabilities(t: Inputs):
    return ops.top_vulnerabilities(t.v_findings)


@query(ROLLUP + """SELECT strftime(created_at, '%Y-%m-%d %H:00') AS hour, sum(critical)::BIGINT AS critical, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low
FROM r WHERE status = 'completed' GROUP BY 1 ORDER BY 1 LIMIT 30""")
def hourly_trend(t: Inputs):
    return ops.hourly_trend(stored.scan_rollup(t.v_scans, t.v_findings))


@query(ROLLUP + """SELECT strftime(created_at, '%Y-%m-%d %H:00') AS hour, sum(critical)::BIGINT AS critical, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low
FROM r WHERE status = 'completed' GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def latest_trend(t: Inputs):
    return ops.hourly_trend(stored.scan_rollup(t.v_scans, t.v_findings), latest=True)


@query(ROLLUP + """, h AS (SELECT strftime(created_at, '%Y-%m-%d %H:00') AS hour, sum(critical)::BIGINT AS critical, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low
FROM r WHERE status = 'completed' GROUP BY 1 ORDER BY 1 LIMIT 1) SELECT * FROM h UNION ALL SELECT 'Start', 0, 0, 0, 0""")
def pad_trend(t: Inputs):
    return ops.pad_trend(ops.hourly_trend(stored.scan_rollup(t.v_scans, t.v_findings), hours=1))


@query("""SELECT least(round(10.0*count(*) FILTER (severity='critical') + 5*count(*) FILTER (severity='high') + 2*count(*) FILTER (severity='medium')
 + 0.5*count(*) FILTER (severity='low') + 0.1*count(*) FILTER (severity='info'), 1), 100)::DOUBLE AS risk_score FROM v_findings""")
def risk_score(t: Inputs):
    return ops.risk_score(t.v_findings)


@query("""SELECT scan_id, risk, CASE WHEN risk > 80 THEN 'Critical' WHEN risk > 50 THEN 'High' WHEN risk > 20 THEN 'Moderate' ELSE 'Low' END AS label FROM (
 SELECT s.scan_id, least(100, coalesce(sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 7 WHEN 'low' THEN 2 ELSE 0 END), 0))::INT AS risk
 FROM v_scans s LEFT JOIN v_findings f ON f.scan_id = s.scan_id GROUP BY 1)""")
def scan_risk(t: Inputs):
    return ops.scan_risk(t.v_findings, t.v_scans)


@query("""WITH p AS (SELECT scan_id, sum(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 8 WHEN 'medium' THEN 2 ELSE 0 END) AS penalty FROM v_findings GROUP BY 1)
SELECT scan_id, framework, greatest(low, least(100, floor(100 - penalty * k + 0.5)))::BIGINT AS score
FROM p, (VALUES ('RBI-CSF', 1.1::DOUBLE, 15), ('NIST-CSF', 0.9::DOUBLE, 20), ('SOC-2', 1.05::DOUBLE, 18), ('OWASP-10', 1.25::DOUBLE, 10)) AS f(framework, k, low)""")
def framework_health_by_scan(t: Inputs):
    return ops.framework_health(t.v_findings, "scan_id")


@query("""SELECT framework, score FROM (VALUES ('RBI-CSF', 15::BIGINT), ('NIST-CSF', 20), ('SOC-2', 18), ('OWASP-10', 10)) AS f(framework, score)
 WHERE (SELECT count(*) FROM v_findings WHERE severity = 'critical') > 100""")
def framework_health(t: Inputs):
    return ops.framework_health(t.v_findings)


@query("""SELECT s.scan_id, CASE WHEN count(f.finding_id) = 0 THEN 'No active findings were detected in the scanned target. The application satisfies all primary Palisade vulnerability checks.'
 ELSE concat_ws(' ', CASE WHEN count(*) FILTER (severity IN ('critical','high')) > 0 THEN 'This scan identified ' || count(*) FILTER (severity IN ('critical','high')) || ' high-priority security risks that should be reviewed before release.' END,
  CASE WHEN bool_or(category = 'secret') THEN 'Credential exposure risk was detected in source or configuration files. Exposed tokens represent immediate access hazards.' END,
  CASE WHEN bool_or(category = 'cve') THEN 'Known vulnerable dependencies were found in project manifests. Legacy packages should be updated to address known exploits.' END,
  CASE WHEN bool_or(category = 'misconfig') THEN 'Configuration weaknesses may increase production exposure. Review deployment baselines to prevent environment leakage.' END) END AS summary
FROM v_scans s LEFT JOIN v_findings f ON f.scan_id = s.scan_id GROUP BY s.scan_id""")
def executive_summary(t: Inputs):
    return ops.executive_summary(t.v_scans, t.v_findings)


@query("""SELECT s.scan_id, b.bucket, count(f.finding_id) AS n, coalesce(string_agg(DISTINCT upper(category), ', ' ORDER BY upper(category)), 'None') AS categories
FROM (SELECT DISTINCT scan_id FROM v_findings) s CROSS JOIN (VALUES ('now'), ('sprint'), ('backlog')) AS b(bucket)
LEFT JOIN v_findings f ON f.scan_id = s.scan_id AND b.bucket = CASE WHEN severity IN ('critical','high') THEN 'now' WHEN severity = 'medium' THEN 'sprint' ELSE 'backlog' END
GROUP BY 1, 2""")
def remediation_buckets(t: Inputs):
    return ops.remediation_buckets(t.v_findings)


@query("""SELECT s.scan_id, count(*) FILTER (severity IN ('critical','high')) AS serious, count(*) FILTER (severity IN ('critical','high')) = 0 AS passed,
  (count(*) FILTER (severity IN ('critical','high')) > 0)::INT AS exit_code FROM v_scans s LEFT JOIN v_findings f ON f.scan_id = s.scan_id GROUP BY 1""")
def gate(t: Inputs):
    return stored.gate(t.v_findings, t.v_scans)


@query("""
SELECT 'scan-' || scan_id AS id, 'Vulnerability scan completed (' || scan_type || ')' AS action, target, CASE status WHEN 'failed' THEN 'error' ELSE 'success' END AS status FROM v_scans
UNION ALL SELECT 'fix-' || finding_id, 'Applied Auto-Fix patch for ' || title, file_path || ':L' || line_number, 'success' FROM v_findings WHERE is_fixed
UNION ALL SELECT 'vuln-' || finding_id, upper(severity) || ' vulnerability detected', title || ' in ' || file_path, 'warning' FROM v_findings WHERE NOT is_fixed AND severity IN ('critical','high')
UNION ALL SELECT 'audit-' || audit_id, action || ' (Operator: ' || operator || ') — Justification: "' || justification || '"', 'System', status FROM v_audit""")
def activity_feed(t: Inputs):
    scans = t.v_scans.withColumn("completed_at", F.lit(None).cast("timestamp_ntz"))
    audit = t.v_audit.withColumns({"target": F.lit(None).cast("string"), "timestamp": F.lit("2024-01-01").cast("timestamp_ntz")})
    return ops.activity_feed(scans, t.v_findings, audit).select("id", "action", "target", "status")


@query("SELECT audit_id, action, operator, status FROM v_audit")
def audit_log(t: Inputs):
    dated = t.v_audit.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    return ops.audit_log(dated).select("audit_id", "action", "operator", "status")


@query("""SELECT scan_id, CASE WHEN status <> 'running' THEN floor(length(target) * 1.5 + 0.5)::BIGINT END AS duration_seconds FROM v_scans""")
def scan_duration(t: Inputs):
    took = F.expr("make_dt_interval(0, 0, 0, length(target) * 1.5)")
    timed = t.v_scans.withColumns(
        {
            "started_at": c("created_at"),
            "completed_at": F.when(c("status") != "running", c("created_at") + took),
        }
    )
    return stored.scan_duration(timed).select("scan_id", "duration_seconds")


@query("""
SELECT s.scan_id, s.scan_type, coalesce(m.n, 0) AS manifests_scanned, coalesce(d.n, 0) AS dependencies,
  CASE WHEN s.scan_type IN ('full','misconfig') THEN 11 ELSE 0 END AS rules_loaded
FROM v_scans s LEFT JOIN (SELECT CAST(s_nationkey AS STRING) AS scan_id, count(*) AS n FROM supplier GROUP BY 1) m ON m.scan_id = s.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM v_findings WHERE category = 'cve' GROUP BY 1) d ON d.scan_id = s.scan_id""")
def scan_metadata(t: Inputs):
    manifests = t.supplier.select(c("s_nationkey").cast("string").alias("scan_id"))
    return ops.scan_metadata(t.v_scans, manifests, t.v_findings.filter("category = 'cve'"), 11)


@query("""SELECT CAST(s_nationkey AS STRING) AS scan_id, 'package.json' AS manifest FROM supplier WHERE s_nationkey % 2 = 0
UNION ALL SELECT CAST(s_nationkey AS STRING), '/srv/m' || CAST(s_suppkey AS STRING) || '/package.json' FROM supplier WHERE s_nationkey % 2 = 1""")
def scanned_manifests(t: Inputs):
    manifests = t.sql("SELECT CAST(s_nationkey AS STRING) || '-' || CAST(m.s_suppkey AS STRING) AS scan_id, path, s_nationkey FROM v_manifests m JOIN supplier s ON s.s_suppkey = m.s_suppkey")
    roots = manifests.select(
        "scan_id",
        F.when(c("s_nationkey") % 2 == 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("/other").alias("root"),
    )
    rows = ops.scanned_manifests(manifests.select("scan_id", "path"), roots)
    return rows.withColumn("scan_id", F.substring_index("scan_id", "-", 1))
