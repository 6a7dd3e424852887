"""A corpus scan from files to stored findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import clean_path
from palisade.operators import detect
from palisade.operators.findings import dedupe_findings, fill_evidence, match_hash, persist_mapping
from palisade.operators.scoring import score
from palisade.session import cut_lineage

# Which scan types run which detector. History also runs in a full scan.
ROUTES = {
    "cve": ["full", "dependencies"],
    "misconfig": ["full", "misconfig"],
    "secret": ["full", "secrets"],
    "drift": ["full", "drift"],
    "sast": ["full", "sast"],
    "git-history": ["full", "git-history"],
}
FIRST = ["detector", "file_path", "position"]


def routed(rows: DataFrame, scans: DataFrame, detector: str) -> DataFrame:
    """Rows of the scans whose type runs this detector."""
    wanted = scans.filter(F.col("scan_type").isin(ROUTES[detector])).select("scan_id")
    return rows.join(wanted, "scan_id", "left_semi")


def all_detectors(
    files: DataFrame,
    scans: DataFrame,
    rules: DataFrame,
    patterns: DataFrame,
    checks: DataFrame,
    others: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Findings of all detectors, each for the scans whose type asks for it.

    The three text detectors share one pass over the files. If the files carry `scan_type` they are
    not joined at all, which is how a large corpus should come. `others` holds findings of
    dependencies (cve), analysers (sast) and history (git-history).
    """
    if "scan_type" not in files.columns:
        files = files.join(scans.select("scan_id", "scan_type"), "scan_id")
    found = detect.scan_files(files, rules, patterns, checks, only_config=True, routes=ROUTES)
    for name, rows in (others or {}).items():
        found = found.unionByName(routed(rows, scans, name), allowMissingColumns=True)
    return found


def with_finding_id(df: DataFrame) -> DataFrame:
    """A stable id from what makes a finding unique, so that a repeated run gives the same ids."""
    parts = [
        F.coalesce(c, F.lit(""))
        for c in (
            F.col("scan_id"), F.col("rule_id"), F.col("file_path"),
            F.col("line_number").cast("string"), F.col("evidence"), match_hash(df),
        )
    ]
    return df.withColumn("finding_id", F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32)))


def stored_findings(raw: DataFrame, files: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Score (on the full path), fill evidence, shorten paths, keep the first of each, map to stored values.

    The order matters: folder patterns need the full path, the deduplication key the short one.
    `roots` (scan_id, root) gives the folder that paths are relative to. With `files`, missing
    evidence is filled in; the findings are then written out first, because they are needed twice and
    must not cost a second pass over the corpus.
    """
    df = score(raw)
    if files is not None:
        df = fill_evidence(cut_lineage(df), files)
    if roots is not None:
        df = (
            df.join(roots.select("scan_id", "root"), "scan_id", "left")
            .withColumn("file_path", clean_path(F.col("file_path"), F.coalesce("root", F.lit(""))))
            .drop("root")
        )
    df = dedupe_findings(df, FIRST)
    return with_finding_id(persist_mapping(df)).drop("context_keyword").withColumns(
        {"is_fixed": F.lit(False), "created_at": F.current_timestamp()}
    )


def severity_by_scan(findings: DataFrame) -> DataFrame:
    """scan_id, severity, n."""
    return findings.groupBy("scan_id", "severity").agg(F.count("*").alias("n"))
