"""Removing and closing scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.base import any_of

# What the demo purge looks for.
DEMO_PATHS = ["%vulnerable%", "%test-target%"]
DEMO_EVIDENCE = ["%vulnerable_demo%"]
CANCELLED = "Scan cancelled by user"


def finished_scans(scans: DataFrame, active: DataFrame) -> DataFrame:
    """Ids of scans that a clean-up removes: completed, failed, or not among the active ids."""
    flagged = scans.select("scan_id", "status").join(
        active.select("scan_id", F.lit(True).alias("_active")).distinct(), "scan_id", "left"
    )
    return flagged.filter(F.col("status").isin("completed", "failed") | F.col("_active").isNull()).select("scan_id")


def clear_history(scans: DataFrame, findings: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans kept, findings kept, and one row with what was deleted."""
    gone = finished_scans(scans, active)
    kept_scans = scans.join(gone, "scan_id", "left_anti")
    kept_findings = findings.join(gone, "scan_id", "left_anti")
    per_kind = gone.agg(F.count("*").alias("n")).withColumn("what", F.lit("deleted_scans")).unionByName(
        findings.groupBy("scan_id")
        .agg(F.count("*").alias("n"))
        .join(gone, "scan_id", "left_semi")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        .withColumn("what", F.lit("deleted_findings"))
    )
    report = per_kind.agg(
        *[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("deleted_scans", "deleted_findings")]
    )
    return kept_scans, kept_findings, report


def purge_matching(
    scans: DataFrame,
    findings: DataFrame,
    paths: list[str] = DEMO_PATHS,
    evidence: list[str] = DEMO_EVIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """Scans and findings left after dropping those that fit a pattern, in any case; findings go with their scan."""
    like = lambda c, patterns: any_of([F.coalesce(F.col(c), F.lit("")).ilike(p) for p in patterns])
    gone = scans.filter(like("target", paths)).select("scan_id")
    left = findings.filter(~(like("file_path", paths) | like("evidence", evidence)))
    return scans.filter(~like("target", paths)), left.join(gone, "scan_id", "left_anti")


def fail_orphans(scans: DataFrame, now: str) -> DataFrame:
    """Running scans of a stopped service become failed at `now`."""
    orphan = F.col("status") == "running"
    at = F.lit(now).cast("timestamp_ntz")
    done = F.col("completed_at") if "completed_at" in scans.columns else F.lit(None).cast("timestamp_ntz")
    return scans.withColumns(
        {
            "completed_at": F.when(orphan, at).otherwise(done),
            "status": F.when(orphan, "failed").otherwise(F.col("status")),
        }
    )


def cancel_transitions(scans: DataFrame, requests: DataFrame) -> DataFrame:
    """Scans after cancel requests (scan_id, at): open ones fail with an error text, others stay."""
    asked = requests.groupBy("scan_id").agg(F.min("at").alias("_at"))
    joined = scans.join(asked, "scan_id", "left")
    hit = F.col("_at").isNotNull() & F.col("status").isin("pending", "running")
    done = F.col("completed_at") if "completed_at" in scans.columns else F.lit(None).cast("timestamp_ntz")
    error = F.col("error") if "error" in scans.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "completed_at": F.when(hit, F.col("_at")).otherwise(done),
            "error": F.when(hit, CANCELLED).otherwise(error),
            "status": F.when(hit, "failed").otherwise(F.col("status")),
        }
    ).drop("_at")
