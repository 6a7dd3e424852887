"""Scores, evidence, deduplication and stored values."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.operators import findings as ops
from palisade.operators import scoring

c = F.col

# SQL forms of the folder patterns and of the banking words
BANKING_SQL = (
    r"'(?i)[\\/](payment|payments|checkout|billing|card|auth|authorization|authentication|login|transaction|transactions"
    r"|ledger|transfer|transfers|wallet|wallets)([\\/]|$)'"
)
WORDS_SQL = "'" + "|".join(scoring.BANKING_WORDS) + "'"
TESTS_SQL = r"'(?i)[\\/](test|tests|__tests__|spec|specs|testing|test_|_test)[\\/]'"
EXAMPLES_SQL = r"'(?i)[\\/](example|examples|sample|samples|demo|demos|fixtures|mock|mocks)[\\/]'"
PROD_SQL = r"'(?i)(prod|live|release|deploy)'"

SCORED = f"""
WITH m AS (SELECT *,
  CASE WHEN cvss_score > 0 THEN cvss_score ELSE CASE severity WHEN 'critical' THEN 9.5 WHEN 'high' THEN 7.5 WHEN 'medium' THEN 5 WHEN 'low' THEN 2.5 ELSE 0.5 END END::DOUBLE AS base_score,
  regexp_matches(file_path, {BANKING_SQL}) AS m1, regexp_matches(file_path, {PROD_SQL}) AS m2,
  category = 'cve' AND NOT is_transitive AS m3, category = 'secret' AND NOT regexp_matches(file_path, {TESTS_SQL}) AS m4,
  regexp_matches(lower(file_path || ' ' || evidence || ' ' || title), {WORDS_SQL}) AS m5,
  regexp_matches(file_path, {TESTS_SQL}) AS m6, regexp_matches(file_path, {EXAMPLES_SQL}) AS m7 FROM v_findings),
s AS (SELECT *, greatest(0.0, least(10.0, base_score + 2*m1::INT + 2*m2::INT + m3::INT + m4::INT + 1.5::DOUBLE*m5::INT - m6::INT - 0.5::DOUBLE*m7::INT)) AS f FROM m),
scored AS (SELECT *, round(f, 1) AS final_score,
  CASE WHEN f >= 9 THEN 'critical' WHEN f >= 7 THEN 'high' WHEN f >= 4 THEN 'medium' WHEN f >= 1 THEN 'low' ELSE 'info' END AS scored_severity FROM s)
"""


def _modifier_names(df):
    return F.array_join(F.transform("modifiers", lambda m: F.concat(m["name"], m["delta"].cast("string"))), ",")


@query(SCORED + """SELECT finding_id, base_score, final_score, scored_severity AS severity, severity AS original_severity,
  concat_ws(',', CASE WHEN m1 THEN 'critical_banking_module2.0' END, CASE WHEN m2 THEN 'production_config2.0' END, CASE WHEN m3 THEN 'direct_dependency1.0' END,
    CASE WHEN m4 THEN 'secret_non_test1.0' END, CASE WHEN m5 THEN 'banking_context1.5' END, CASE WHEN m6 THEN 'test_directory-1.0' END, CASE WHEN m7 THEN 'example_directory-0.5' END) AS modifiers
FROM scored""")
def contextual_score(t: Inputs):
    scored = scoring.score(t.busy.v_findings.withColumn("description", F.lit("")))
    return scored.select(
        "finding_id", "base_score", "final_score", "severity", "original_severity",
        _modifier_names(scored).alias("modifiers"),
    )


@query(SCORED + "SELECT scored_severity AS severity, final_score, count(*) AS n FROM scored GROUP BY 1, 2")
def score_distribution(t: Inputs):
    scored = scoring.score_all(t.busy.v_findings)
    return scored.groupBy("severity", "final_score").agg(F.count("*").alias("n"))


@query("""
SELECT finding_id, CASE WHEN title IS NULL OR severity IS NULL THEN 5.0::DOUBLE END AS fallback_score,
  CASE WHEN title IS NULL OR severity IS NULL THEN coalesce(severity, 'medium') END AS fallback_severity
FROM (SELECT finding_id, CASE WHEN line_number % 3 = 0 THEN NULL ELSE title END AS title, CASE WHEN line_number % 4 = 0 AND category <> 'cve' THEN NULL ELSE severity END AS severity FROM v_findings)""")
def score_fallback(t: Inputs):
    broken = t.busy.v_findings.withColumns(
        {
            "title": F.when(c("line_number") % 3 != 0, c("title")),
            "severity": F.when((c("line_number") % 4 != 0) | (c("category") == "cve"), c("severity")),
        }
    )
    scored = scoring.score(broken)
    bad = c("title").isNull() | c("original_severity").isNull()
    return scored.select(
        "finding_id",
        F.when(bad, c("final_score")).alias("fallback_score"),
        F.when(bad, c("severity")).alias("fallback_severity"),
    )


@query(r"""
SELECT finding_id, CASE WHEN trim(evidence) IN ('', 'requires login') THEN coalesce(CASE WHEN line_number >= 1 THEN
   list_extract(string_split(regexp_replace(content, '\n$', ''), chr(10)), line_number) END, evidence) ELSE evidence END AS evidence
FROM v_doc_findings JOIN v_files ON file_path = path AND v_doc_findings.scan_id = v_files.scan_id""")
def fill_evidence(t: Inputs):
    return ops.fill_evidence(t.v_doc_findings, t.v_files).select("finding_id", "evidence")


@query("""
SELECT min(finding_id) AS finding_id, rule_id, file_path, line_number, left(evidence, 120) AS evidence_start
FROM v_findings GROUP BY rule_id, file_path, line_number, left(evidence, 120)""")
def dedupe_across_scans(t: Inputs):
    one = t.busy.v_findings.withColumn("scan_id", F.lit("all"))
    return ops.dedupe_findings(one, ["finding_id"]).select(
        "finding_id", "rule_id", "file_path", "line_number", F.left("evidence", F.lit(120)).alias("evidence_start")
    )


@query("""
SELECT min(finding_id) AS finding_id, scan_id, rule_id FROM v_findings GROUP BY scan_id, rule_id, file_path, line_number, left(evidence, 120)""")
def dedupe_findings(t: Inputs):
    return ops.dedupe_findings(t.busy.v_findings, ["finding_id"]).select("finding_id", "scan_id", "rule_id")


@query("""
SELECT finding_id, severity, CASE WHEN category = 'cve' THEN rule_id END AS cve_id, nullif(cvss_score, 0) AS cvss_score,
  CASE WHEN line_number > 3 THEN 0 ELSE line_number END AS line_number FROM v_findings""")
def persist_mapping(t: Inputs):
    df = t.v_findings.withColumns(
        {
            "severity": F.upper("severity"),
            "line_number": F.when(c("line_number") <= 3, c("line_number")),
            "cvss_score": F.coalesce("cvss_score", F.lit(0.0)),
        }
    )
    return ops.persist_mapping(df).select("finding_id", "severity", "cve_id", "cvss_score", "line_number")


@query("""
SELECT s.scan_id, s.status, count(f.finding_id) AS total_findings, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
  count(*) FILTER (severity = 'medium') AS medium_count, count(*) FILTER (severity IN ('low','info')) AS low_count
FROM v_scans s LEFT JOIN v_findings f ON f.scan_id = s.scan_id GROUP BY s.scan_id, s.status""")
def scan_rollup(t: Inputs):
    return ops.scan_rollup(t.v_scans, t.v_findings).select("scan_id", "status", *ops.COUNTERS)
