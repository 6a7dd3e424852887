"""Findings out of the JSON reports of two static analysers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import map_sast_severity
from palisade.operators.common import finding
from palisade.schemas import BANDIT_REPORT, SEMGREP_REPORT


def _or(c: Column, text: str) -> Column:
    return F.coalesce(c, F.lit(text))


def _link(c: Column) -> Column:
    """One reference, or none if the report has none."""
    return F.when(_or(c, "") != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def semgrep_findings(reports: DataFrame) -> DataFrame:
    """Rows of (scan_id, document) reports with a `results` list of checks."""
    doc = F.from_json("document", SEMGREP_REPORT)
    rows = reports.select("scan_id", doc.alias("_doc")).select(
        "scan_id", F.posexplode("_doc.results").alias("_no", "r")
    )
    rule = _or(F.col("r.check_id"), "SEMGREP-UNKNOWN")
    fix = F.col("r.extra.metadata.fix")
    return rows.select(
        finding(
            "sast",
            scan_id=F.col("scan_id"),
            rule_id=rule,
            title=F.left(_or(F.col("r.extra.message"), "Semgrep finding"), F.lit(200)),
            description=_or(F.col("r.extra.message"), ""),
            severity=map_sast_severity(F.lit("semgrep"), _or(F.col("r.extra.severity"), "INFO")),
            category=F.lit("sast"),
            file_path=_or(F.col("r.path"), ""),
            line_number=F.col("r.start.line"),
            evidence=_or(F.col("r.extra.lines"), ""),
            remediation=F.when(_or(fix, "") != "", fix).otherwise(
                "Review and remediate per Semgrep rule guidance."
            ),
            references=_link(F.col("r.extra.metadata.source-url")),
            tags=F.array(F.lit("sast"), F.lit("semgrep")),
            metadata=F.create_map(F.lit("tool"), F.lit("semgrep"), F.lit("check_id"), rule),
            position=F.col("_no").cast("bigint"),
        )
    )


def bandit_findings(reports: DataFrame) -> DataFrame:
    """Rows of (scan_id, document) reports with a `results` list of tests."""
    doc = F.from_json("document", BANDIT_REPORT)
    rows = reports.select("scan_id", doc.alias("_doc")).select(
        "scan_id", F.posexplode("_doc.results").alias("_no", "r")
    )
    rule = _or(F.col("r.test_id"), "BANDIT-UNKNOWN")
    cwe = F.when(F.col("r.issue_cwe.id") != 0, F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id").cast("string")))
    return rows.select(
        finding(
            "sast",
            scan_id=F.col("scan_id"),
            rule_id=rule,
            title=_or(F.col("r.test_name"), "Bandit finding"),
            description=_or(F.col("r.issue_text"), ""),
            severity=map_sast_severity(F.lit("bandit"), _or(F.col("r.issue_severity"), "LOW")),
            category=F.lit("sast"),
            file_path=_or(F.col("r.filename"), ""),
            line_number=F.col("r.line_number"),
            evidence=_or(F.col("r.code"), ""),
            remediation=F.concat(
                F.lit("See Bandit docs for "), rule, F.lit(": "), _or(F.col("r.more_info"), "")
            ),
            references=_link(F.col("r.more_info")),
            tags=F.array(F.lit("sast"), F.lit("bandit")),
            metadata=F.create_map(
                F.lit("tool"), F.lit("bandit"), F.lit("test_id"), rule, F.lit("cwe"), cwe
            ),
            position=F.col("_no").cast("bigint"),
        )
    )
