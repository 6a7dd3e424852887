"""Report documents, as lines and as the facts in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.operators import compliance, dashboard, intel, sbom
from palisade.sources import exports

c = F.col


def _described(t: Inputs):
    return t.busy.v_findings.withColumns(
        {
            "description": F.concat(F.lit("about "), "title"),
            "remediation": F.when(c("category") == "drift", "").otherwise(F.concat(F.lit("fix "), "title")),
        }
    )


def _shape(lines):
    """What the text of the lines says, without running numbers and time."""
    return lines.groupBy("scan_id", "section").agg(
        F.count("*").alias("n"), F.count_if(c("line").startswith(",")).alias("n_commas")
    )


@query("""SELECT s.scan_id, section, CASE WHEN section = 1 THEN n ELSE 1 END AS n, CASE WHEN section = 1 THEN n - 1 ELSE 0 END AS n_commas
FROM v_scans s CROSS JOIN (VALUES (0), (1), (2)) AS p(section) LEFT JOIN (SELECT scan_id, count(*) AS n FROM v_findings GROUP BY 1) f ON f.scan_id = s.scan_id WHERE section <> 1 OR n > 0""")
def json_report_lines(t: Inputs):
    return _shape(exports.to_json_report(t.busy.v_findings, t.v_scans))


@query("""SELECT scan_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (category = 'cve') AS cve
FROM v_findings GROUP BY 1""")
def json_report_summary(t: Inputs):
    head = exports.to_json_report(t.busy.v_findings, t.v_scans).filter("section = 0")
    doc = F.from_json(
        F.concat("line", F.lit("]}")),
        "summary struct<total:bigint,by_severity:struct<critical:bigint,info:bigint>,by_category:map<string,bigint>>",
    )
    return head.select("scan_id", doc.alias("d")).select(
        "scan_id", "d.summary.total", "d.summary.by_severity.critical", "d.summary.by_severity.info",
        F.coalesce(F.try_element_at("d.summary.by_category", F.lit("cve")), F.lit(0)).alias("cve"),
    ).filter("total > 0")


# finding ids repeat in the smallest table, so two more columns decide
ORDER = ["finding_id", "severity", "created_at"]
FIRST = "o AS (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY finding_id, severity, created_at) AS n FROM v_findings), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY finding_id, severity, created_at) - 1 AS rule_index FROM o WHERE n = 1)"


@query(f"WITH {FIRST} SELECT scan_id, rule_id, rule_index::INT AS rule_index, title, finding_id, severity FROM r")
def sarif_rules(t: Inputs):
    rules = exports.sarif_rules(t.busy.v_findings, ORDER)
    return rules.select("scan_id", "rule_id", "rule_index", "title", "finding_id", "severity")


@query(f"""WITH {FIRST} SELECT f.finding_id, r.rule_index::INT AS rule_index, CASE f.severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
 f.file_path AS uri, greatest(1, f.line_number) AS start_line, f.rule_id || ':' || f.file_path || ':' || greatest(1, f.line_number) AS fingerprint, f.category <> 'drift' AS has_fix
FROM v_findings f JOIN r ON r.scan_id = f.scan_id AND r.rule_id = f.rule_id""")
def sarif_results(t: Inputs):
    found = _described(t)
    rows = exports.sarif_results(found, exports.sarif_rules(found, ORDER))
    return rows.select("finding_id", "rule_index", "level", "uri", "start_line", "fingerprint", "has_fix")


@query("""WITH n AS (SELECT scan_id, count(DISTINCT rule_id) AS rules, count(*) AS results FROM v_findings GROUP BY 1), p AS (SELECT s.scan_id, section, CASE section WHEN 1 THEN rules WHEN 3 THEN results ELSE 1 END AS n
 FROM v_scans s CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS x(section) LEFT JOIN n ON n.scan_id = s.scan_id)
SELECT scan_id, section, n, CASE WHEN section IN (1, 3) THEN n - 1 ELSE 0 END AS n_commas FROM p WHERE n IS NOT NULL""")
def sarif_lines(t: Inputs):
    return _shape(exports.to_sarif(_described(t), t.v_scans, ORDER))


@query("""WITH n AS (SELECT scan_id, count(*) AS n FROM v_findings WHERE category = 'cve' GROUP BY 1)
SELECT s.scan_id, section, CASE section WHEN 1 THEN n ELSE 1 END AS n, CASE section WHEN 1 THEN n - 1 ELSE 0 END AS n_commas FROM v_scans s CROSS JOIN (VALUES (0), (1), (2)) AS x(section)
LEFT JOIN n ON n.scan_id = s.scan_id WHERE section <> 1 OR n IS NOT NULL""")
def cyclonedx_lines(t: Inputs):
    deps = t.v_findings.filter("category = 'cve'").select(
        "scan_id", c("rule_id").alias("name"), F.lit("1").alias("version"), F.lit("npm").alias("ecosystem")
    )
    return _shape(exports.to_cyclonedx(sbom.sbom_packages(deps), t.v_scans))


@query("""WITH f AS (SELECT scan_id, count(*) AS n FROM v_findings GROUP BY 1), m AS (SELECT scan_id, count(DISTINCT cve_id) AS n FROM v_findings WHERE cve_id IS NOT NULL GROUP BY 1),
p AS (SELECT s.scan_id, section, CASE section WHEN 1 THEN f.n WHEN 3 THEN m.n ELSE 1 END AS n FROM v_scans s CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS x(section) LEFT JOIN f ON f.scan_id = s.scan_id LEFT JOIN m ON m.scan_id = s.scan_id)
SELECT scan_id, section, n, CASE WHEN section IN (1, 3) THEN n - 1 ELSE 0 END AS n_commas FROM p WHERE n IS NOT NULL""")
def report_payload_lines(t: Inputs):
    # what the payload does not show is not moved
    parts = exports.scan_parts(t.busy.v_findings.drop("is_transitive", "created_at"), t.v_scans)
    mentions = [intel.cve_mentions(findings) for findings, _, _ in parts]
    every = reduce(DataFrame.unionByName, mentions)
    exploited = intel.enrich_cves(every.select("cve_id", "cvss"), t.v_kev, t.v_epss)
    return _shape(reduce(DataFrame.unionByName, [_payload(t, *part, said, exploited) for part, said in zip(parts, mentions)]))


def _payload(t: Inputs, findings: DataFrame, scans: DataFrame, in_place: bool, mentions: DataFrame, exploited: DataFrame):
    records = intel.scan_records(mentions, t.v_kev, t.v_epss)
    top = dashboard.top_risks(findings, exploited, in_place=in_place)
    deps = findings.filter("category = 'cve'").select(
        "scan_id", c("rule_id").alias("name"), F.lit("1").alias("version"), F.lit("npm").alias("ecosystem")
    )
    return exports.export_report_payload(
        scans,
        findings,
        dashboard.scan_risk(findings),
        dashboard.executive_summary(scans, findings),
        top,
        compliance.compliance_score(compliance.scan_controls(findings, scans)),
        sbom.sbom_packages(deps),
        records,
        in_place,
    )
