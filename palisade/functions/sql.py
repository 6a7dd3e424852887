"""Scans in SQL: views over the files and their findings, and table functions with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.functions.severity import RANK
from palisade.operators.detect import scan_files
from palisade.plans.scan import stored_findings

FOUND = "scan_id STRING, finding_id STRING, rule_id STRING, title STRING, category STRING, severity STRING, file_path STRING, line_number INT, evidence STRING"
NAMES = ", ".join(c.split()[0] for c in FOUND.split(", "))


def register_sql(spark: SparkSession, files: DataFrame, rules: DataFrame | None = None, patterns: DataFrame | None = None, checks: DataFrame | None = None) -> None:
    """Temporary views and table functions of a session, over files (scan_id, path, content):

    `palisade_files`; `palisade_findings`, the stored form of all findings in them, scored and once each;
    `findings_of(scan)`; `findings_above(level)`, those at least as severe; `findings_below(folder)`, of files in a folder.
    Nothing runs until a query asks.
    """
    files.createOrReplaceTempView("palisade_files")
    stored_findings(scan_files(files, rules, patterns, checks)).createOrReplaceTempView("palisade_findings")
    rank = "CASE lower({}) " + " ".join(f"WHEN '{level}' THEN {n}" for level, n in RANK.items()) + " ELSE 0 END"
    for name, parameter, condition in (
        ("findings_of", "scan", "scan_id = findings_of.scan"),
        ("findings_above", "level", f"{rank.format('severity')} >= {rank.format('findings_above.level')}"),
        ("findings_below", "folder", "startswith(file_path, findings_below.folder)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter} STRING) RETURNS TABLE ({FOUND}) RETURN SELECT {NAMES} FROM palisade_findings WHERE {condition}")
