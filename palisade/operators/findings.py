"""Selecting, deduplicating, storing and counting findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import count_bucket, normalize_severity, severity_rank
from palisade.operators.common import source_lines
from palisade.schemas import SEVERITIES

FIXABLE = ["secret", "cve", "misconfig", "misconfiguration"]
NO_EVIDENCE = "requires login"


class NotFound(ValueError):
    """A row that was asked for by id does not exist."""


def filter_findings(
    df: DataFrame, scan_id: str | None = None, severity: str | None = None, category: str | None = None
) -> DataFrame:
    """Equal scan and severity, category by part of its name in any case."""
    if severity is not None:
        if severity not in SEVERITIES:
            raise ValueError(f"unknown severity {severity!r}, use one of {', '.join(SEVERITIES)}")
        df = df.filter(F.col("severity") == severity)
    if scan_id is not None:
        df = df.filter(F.col("scan_id") == scan_id)
    if category is not None:
        df = df.filter(F.contains(F.lower("category"), F.lit(category.lower())))
    return df


def search_findings(
    df: DataFrame, text: str = "", severity: str = "all", category: str = "all", scan_id: str = "all"
) -> DataFrame:
    """Text within title, path or rule id in any case, and exact filters; `all` switches one off."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for name in ("title", "file_path", "rule_id"):
        hit = hit | F.contains(F.lower(name), needle)
    for name, wanted in (("severity", severity), ("category", category), ("scan_id", scan_id)):
        if wanted != "all":
            df = df.filter(F.col(name) == wanted)
    return df.filter(hit) if text else df


def min_severity(df: DataFrame, level: str) -> DataFrame:
    """Findings of this level or above."""
    if level not in SEVERITIES:
        raise ValueError(f"unknown severity {level!r}")
    return df.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(level)))


def fixable(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_fixed") & F.col("category").isin(FIXABLE))


def distinct_categories(df: DataFrame) -> DataFrame:
    return df.select("category").distinct()


def get_scan(scans: DataFrame, scan_id: str) -> DataFrame:
    """The row of one scan; an unknown id is an error."""
    row = scans.filter(F.col("scan_id") == scan_id)
    if row.isEmpty():
        raise NotFound(f"scan {scan_id} not found")
    return row


def newest_first(df: DataFrame, id_column: str) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), id_column)


def list_scans(scans: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return newest_first(scans, "scan_id").offset(skip).limit(limit)


def page_findings(df: DataFrame, page: int = 1, per_page: int = 20, **filters: str) -> tuple[int, DataFrame]:
    """Number of findings that pass `filter_findings`, and one page of them, the newest first."""
    kept = filter_findings(df, **filters)
    rows = newest_first(kept, "finding_id").offset((page - 1) * per_page).limit(per_page)
    return kept.count(), rows


def fill_evidence(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Where evidence is missing, take the source line the finding points at, if there is one.

    Only findings that lack evidence meet the files, so the rest are not moved.
    """
    lacks = (F.coalesce("evidence", F.lit("")) == "") | (F.trim("evidence") == NO_EVIDENCE)
    poor = findings.filter(lacks & (F.col("line_number") >= 1))
    lines = source_lines(files, poor.withColumnRenamed("file_path", "path"), 0).select(
        "scan_id",
        F.col("path").alias("file_path"),
        "line_number",
        F.get("lines", F.lit(0))["content"].alias("_line"),
    )
    filled = (
        poor.join(lines, ["scan_id", "file_path", "line_number"], "left")
        .withColumn("evidence", F.coalesce("_line", "evidence"))
        .select(*findings.columns)
    )
    return findings.filter(~(lacks & F.coalesce(F.col("line_number") >= 1, F.lit(False)))).unionByName(filled)


def match_hash(df: DataFrame) -> Column:
    """Hash of the whole match, which a detector leaves in the metadata if the evidence shows only its start."""
    return F.coalesce(F.try_element_at("metadata", F.lit("match_hash")), F.lit("")) if "metadata" in df.columns else F.lit("")


def dedupe_key(df: DataFrame) -> list[Column]:
    return [
        F.col("scan_id"),
        F.col("rule_id"),
        F.col("file_path"),
        F.coalesce("line_number", F.lit(0)),
        F.coalesce("evidence", F.lit("")),
        match_hash(df),
    ]


def dedupe_findings(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row (by `order`) of each scan, rule, path, line and match.

    Map tasks keep one row per key before the shuffle, so copies of one finding, however many,
    reach a reducer as one row per task.
    """
    first = W.partitionBy(*dedupe_key(df)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def persist_mapping(df: DataFrame) -> DataFrame:
    """Values as stored: CVE id of dependency findings, no zero scores, no null lines, known levels."""
    return df.withColumns(
        {
            "severity": normalize_severity(F.col("severity")),
            "cve_id": F.when(F.col("category") == "cve", F.col("rule_id")),
            "cvss_score": F.when(F.col("cvss_score") != 0, F.col("cvss_score")),
            "line_number": F.coalesce("line_number", F.lit(0)),
        }
    )


def bucket_counts() -> list[Column]:
    """total and the four counters as aggregates."""
    bucket = count_bucket(F.col("severity"))
    return [F.count("*").alias("total_findings")] + [
        F.count_if(bucket == level).alias(f"{level}_count") for level in SEVERITIES[:4]
    ]


COUNTERS = ["total_findings", "critical_count", "high_count", "medium_count", "low_count"]


def scan_rollup(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans with their counters; scans without findings have zeros."""
    counts = findings.groupBy("scan_id").agg(*bucket_counts())
    kept = [c for c in scans.columns if c not in COUNTERS]
    return scans.select(*kept).join(counts, "scan_id", "left").fillna(0, COUNTERS)


def gate(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Per scan: number of critical and high findings, and whether the scan passes.

    Give `scans` to include those without findings.
    """
    serious = findings.groupBy("scan_id").agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("serious")
    )
    if scans is not None:
        serious = scans.select("scan_id").join(serious, "scan_id", "left").fillna(0, ["serious"])
    return serious.withColumns(
        {"passed": F.col("serious") == 0, "exit_code": F.when(F.col("serious") == 0, 0).otherwise(1)}
    )


def scan_duration(scans: DataFrame) -> DataFrame:
    """Whole seconds from start to end; null while running."""
    micros = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at"))
    return scans.withColumn("duration_seconds", F.floor(micros / F.lit(1e6) + 0.5))
