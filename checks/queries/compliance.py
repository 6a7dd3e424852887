"""Controls of the frameworks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.functions import compliance_label
from palisade.operators import compliance as ops

c = F.col
CONTROLS_SQL = "ctl(framework, control_id, category, match_cat) AS (VALUES " + ", ".join(
    f"('{x['framework']}', '{x['control_id']}', '{x['category']}', '{x['match_cat']}')" for x in ops.CONTROLS
) + ")"
BAD = """bad AS (SELECT f.* FROM v_findings f JOIN v_scans s ON s.scan_id = f.scan_id AND s.status = 'completed'
  WHERE NOT is_fixed AND severity IN ('critical','high','medium'))"""
GLOBAL = f"WITH {CONTROLS_SQL}, {BAD}, st AS (SELECT framework, control_id, ctl.category, count(finding_id) AS n FROM ctl LEFT JOIN bad ON bad.category = match_cat GROUP BY 1, 2, 3)"


@query(GLOBAL + "SELECT framework, control_id, category, n AS n_findings, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status FROM st")
def compliance_controls(t: Inputs):
    return ops.compliance_controls(t.v_findings, t.v_scans).drop("name", "description")


@query(GLOBAL + """SELECT framework, count(*) AS total_controls, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed,
  round(100 * count(*) FILTER (n = 0) / count(*)::DOUBLE, 1) AS score,
  CASE WHEN round(100 * count(*) FILTER (n = 0) / count(*)::DOUBLE, 1) >= 85 THEN 'Strong' WHEN round(100 * count(*) FILTER (n = 0) / count(*)::DOUBLE, 1) >= 65 THEN 'Needs Review' ELSE 'High Risk' END AS label FROM st GROUP BY 1""")
def compliance_score(t: Inputs):
    scores = ops.compliance_score(ops.compliance_controls(t.v_findings, t.v_scans))
    return scores.withColumn("label", compliance_label(c("score")))


@query(GLOBAL + "SELECT framework, category, floor(100 * count(*) FILTER (n = 0) / count(*)::DOUBLE + 0.5)::BIGINT AS percent FROM st GROUP BY 1, 2")
def control_category_coverage(t: Inputs):
    return ops.control_category_coverage(ops.compliance_controls(t.v_findings, t.v_scans))


@query(f"WITH {CONTROLS_SQL}, {BAD} SELECT framework, control_id, scan_id, finding_id FROM bad JOIN ctl ON match_cat = bad.category")
def control_findings(t: Inputs):
    return ops.control_findings(t.v_findings, t.v_scans)


@query(f"WITH {CONTROLS_SQL}, {BAD} SELECT finding_id FROM bad WHERE category IN (SELECT match_cat FROM ctl WHERE framework = 'soc-2')")
def compliance_findings(t: Inputs):
    return ops.compliance_findings(t.v_findings, t.v_scans, "soc2").select("finding_id")


@query(f"""WITH {CONTROLS_SQL}, f AS (SELECT scan_id, category, count(*) AS n FROM v_findings WHERE NOT is_fixed AND severity IN ('critical','high','medium') GROUP BY 1, 2),
st AS (SELECT s.scan_id, framework, control_id, coalesce(n, 0) AS n FROM v_scans s CROSS JOIN ctl LEFT JOIN f ON f.scan_id = s.scan_id AND f.category = match_cat)
SELECT scan_id, framework, count(*) AS total_controls, count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed, round(100 * count(*) FILTER (n = 0) / count(*)::DOUBLE, 1) AS score FROM st GROUP BY 1, 2""")
def scan_compliance(t: Inputs):
    return ops.compliance_score(ops.scan_controls(t.v_findings, t.v_scans))


def _families(name_column: str) -> str:
    """SQL that a finding breaks a control: by words in the control's name, its category and its title."""
    parts = []
    for names, categories, titles in ops.KEYWORD_FAMILIES:
        by_name = " OR ".join(f"contains(lower({name_column}), '{w}')" for w in names)
        by_finding = " OR ".join([f"contains(category, '{w}')" for w in categories] + [f"contains(lower(title), '{w}')" for w in titles])
        parts.append(f"(({by_name}) AND ({by_finding}))")
    return " OR ".join(parts)


NAMED_SQL = "ctl(framework, number, name, ctl_category) AS (VALUES " + ", ".join(
    f"('{fw}', {i}, '{name}', '{category}')" for fw, rows in ops.NAMED_CONTROLS.items() for i, (name, category) in enumerate(rows, 1)
) + ")"
TITLED = "f AS (SELECT finding_id, category, CASE WHEN category = 'sast' AND severity = 'high' THEN 'XSS sink' WHEN category = 'drift' THEN 'Open port' ELSE title END AS title FROM v_findings WHERE severity <> 'info' AND category <> 'cve')"
KEYWORD = f"WITH {NAMED_SQL}, {TITLED}, st AS (SELECT framework, number, name, ctl_category, (SELECT count(*) FROM f WHERE {_families('name')}) AS n FROM ctl), st2 AS (SELECT *, CASE WHEN n > 0 THEN 'failed' WHEN number = 10 THEN 'not-applicable' ELSE 'passed' END AS status FROM st)"


def _titled(t: Inputs):
    title = (
        F.when((c("category") == "sast") & (c("severity") == "high"), "XSS sink")
        .when(c("category") == "drift", "Open port")
        .otherwise(c("title"))
    )
    return t.v_findings.filter("severity <> 'info' AND category <> 'cve'").withColumn("title", title)


@query(KEYWORD + "SELECT framework, framework || '-' || lpad(number::VARCHAR, 3, '0') AS control_id, name, ctl_category AS category, n AS n_findings, status FROM st2")
def keyword_controls(t: Inputs):
    return ops.keyword_controls(_titled(t)).drop("description")


@query(KEYWORD + """SELECT framework, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'not-applicable') AS not_applicable,
 floor(100 * count(*) FILTER (status = 'passed') / count(*) FILTER (status <> 'not-applicable')::DOUBLE + 0.5)::BIGINT AS score FROM st2 GROUP BY 1""")
def keyword_score(t: Inputs):
    return ops.keyword_score(ops.keyword_controls(_titled(t)))


@query(f"WITH {NAMED_SQL}, {TITLED} SELECT finding_id, framework || '-' || lpad(number::VARCHAR, 3, '0') AS control_id FROM f JOIN ctl ON framework = 'OWASP-10' AND ({_families('name')})")
def keyword_control_findings(t: Inputs):
    return ops.keyword_control_findings(_titled(t), "OWASP-10")
