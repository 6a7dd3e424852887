"""One scan from files, reports, advisories and git dumps to stored findings, over all detectors.

Each scan's type says which detectors run for it. The files are read once: the same pass gives the matches of rules,
secrets and baselines and sets manifests apart, and its result is written, since it is small beside the corpus and
several detectors read it. What a detector refuses is a row of `refused` and does not end the job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import has_excluded_dir, is_manifest
from palisade.operators import advisories as adv
from palisade.operators import analysers, detect, history, log_walk, manifests
from palisade.operators.common import refused_patterns
from palisade.plans.scan import ROUTES, routed, stored_findings
from palisade.session import cut_lineage
from palisade.sources.gitlog import latest_commits

# Scan types, and the commits of a repository that are searched.
SCAN_TYPES = sorted({t for types in ROUTES.values() for t in types})
COMMITS = 500
REFUSED = ["scan_id", "detector", "place", "reason"]


@dataclass(frozen=True)
class ScanInputs:
    """`scans`: scan_id, scan_type. `files`: scan_id, path, content (and relative_path). `advisories`: the feed's documents.
    `reports`: scan_id, tool, document. `git_lines`: `sources.read_git_lines`; the repository names the scan."""

    scans: DataFrame
    files: DataFrame | None = None
    rules: DataFrame | None = None
    patterns: DataFrame | None = None
    checks: DataFrame | None = None
    advisories: DataFrame | None = None
    reports: DataFrame | None = None
    git_lines: DataFrame | None = None
    commits: int = COMMITS


@dataclass(frozen=True)
class ScanResult:
    """`raw`: findings before scoring; `dependencies` and `manifests` of the scans that look at them; `refused`:
    scan_id, detector, place, reason."""

    raw: DataFrame
    dependencies: DataFrame | None
    manifests: DataFrame | None
    refused: DataFrame

    def stored(self, files: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
        return stored_findings(self.raw, files, roots)


def _discovered(files: DataFrame) -> Column:
    """Manifests that a scan looks for, outside the skipped folders."""
    column = "relative_path" if "relative_path" in files.columns else "path"
    return is_manifest(F.col("path")) & ~has_excluded_dir(F.col(column), "manifest")


def _refusal(rows: DataFrame, detector: str, place: Column, reason: Column) -> DataFrame:
    return rows.select(F.col("scan_id"), F.lit(detector).alias("detector"), place.alias("place"), reason.alias("reason"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _scan_texts(inputs: ScanInputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings in texts, the manifests (scan_id, path, content), and what was refused; one pass over the files."""
    known = inputs.scans.filter(F.col("scan_type").isin(SCAN_TYPES)).select("scan_id", "scan_type")
    files = inputs.files.drop("scan_type").join(known, "scan_id")
    wanted = F.col("scan_type").isin(ROUTES["cve"]) & _discovered(files)
    matched, entries = detect.matched_files(
        files, inputs.rules, inputs.patterns, inputs.checks, only_config=True, routes=ROUTES,
        also={"manifest": F.when(wanted, F.col("content")), "is_manifest": wanted, "no_text": F.col("content").isNull()},
    )
    # filtered behind the write: before it, the test for matches would have all patterns run once more
    kept = cut_lineage(matched).filter("size(_matches) > 0 or is_manifest or no_text")
    found = detect.findings_of(kept.select("scan_id", "path", "_matches"), entries)
    of_scans = kept.filter("is_manifest").select("scan_id", "path", F.col("manifest").alias("content"))
    unread = kept.filter("no_text and not is_manifest")
    return found, of_scans, _refusal(unread, "files", F.col("path"), F.lit("no text"))


def _scan_packages(inputs: ScanInputs, of_scans: DataFrame) -> tuple[DataFrame | None, DataFrame, list[DataFrame]]:
    """Findings of affected packages, the packages, and what was refused."""
    kinds = manifests.manifests_of(of_scans)
    deps = cut_lineage(manifests.packages_of(kinds, inputs.files))
    faults = manifests.manifest_faults(of_scans)
    refused = [_refusal(faults, "cve", F.concat_ws("#", "path", "place"), F.col("reason"))]
    if inputs.advisories is None:
        return None, deps, refused
    good = inputs.advisories.filter(F.col("id").isNotNull())
    nameless = inputs.advisories.filter(F.col("id").isNull()).select(F.lit(None).cast("string").alias("scan_id"))
    refused.append(_refusal(nameless, "cve", F.lit(None).cast("string"), F.lit("advisory without an id")))
    return adv.cve_findings(deps, adv.advisory_ranges(good), adv.advisory_flatten(good)), deps, refused


PARSERS = {"semgrep": analysers.semgrep_findings, "bandit": analysers.bandit_findings}


def _scan_reports(inputs: ScanInputs) -> tuple[DataFrame, DataFrame]:
    """Findings of the analysers' reports, and reports that are none."""
    reports = routed(inputs.reports, inputs.scans, "sast")
    doc = F.try_parse_json("document")
    results = F.try_variant_get(doc, "$.results", "array<variant>")
    odd = (
        F.when(~F.col("tool").isin(list(PARSERS)) | F.col("tool").isNull(), "unknown tool")
        .when(F.col("document").isNull() | doc.isNull(), "no JSON")
        .when(results.isNull(), "no results")
    )
    found = [parse(reports.filter(F.col("tool") == tool)) for tool, parse in PARSERS.items()]
    return _union(found), _refusal(reports.filter(odd.isNotNull()), "sast", F.col("tool"), odd)


def _scan_history(inputs: ScanInputs) -> tuple[DataFrame, DataFrame]:
    """Secrets in the newest commits, and headers that are none."""
    wanted = inputs.scans.filter(F.col("scan_type").isin(ROUTES["git-history"])).select(F.col("scan_id").alias("repo"))
    lines = inputs.git_lines  # in the order of the log; scans are chosen behind the walk
    newest = latest_commits(log_walk.commit_headers(lines), inputs.commits)
    added = log_walk.latest_lines(log_walk.added_lines(lines), newest).join(wanted, "repo", "left_semi")
    short = F.col("line").startswith(log_walk.HEADER) & (F.size(F.split("line", r"\|", 5)) < 5)
    broken = lines.filter(short).join(wanted, "repo", "left_semi").withColumnRenamed("repo", "scan_id")
    return history.history_scan(added, inputs.patterns), _refusal(broken, "git-history", F.left("line", F.lit(200)), F.lit("broken header"))


def run_scan(inputs: ScanInputs) -> ScanResult:
    """Findings of all detectors that the given inputs and the types of the scans ask for."""
    found, refused, deps, of_scans = [], [], None, None
    unknown = inputs.scans.filter(~F.coalesce(F.col("scan_type").isin(SCAN_TYPES), F.lit(False)))
    refused.append(_refusal(unknown, "scan", F.col("scan_type"), F.lit("unknown scan type")))
    for name, table in (("misconfig", inputs.rules), ("secret", inputs.patterns), ("drift", inputs.checks)):
        if table is not None:
            rows = refused_patterns(table).withColumn("scan_id", F.lit(None).cast("string"))
            refused.append(_refusal(rows, name, F.col("name"), F.col("reason")))
    if inputs.files is not None:
        texts, of_scans, unread = _scan_texts(inputs)
        packages, deps, faults = _scan_packages(inputs, of_scans)
        found += [texts] if packages is None else [packages, texts]
        refused += [unread, *faults]
    if inputs.reports is not None:
        rows, odd = _scan_reports(inputs)
        found.append(rows)
        refused.append(odd)
    if inputs.git_lines is not None and inputs.patterns is not None:
        rows, odd = _scan_history(inputs)
        found.append(rows)
        refused.append(odd)
    if not found:
        raise ValueError("nothing to scan")
    listed = None if of_scans is None else of_scans.select("scan_id", "path")
    return ScanResult(_union(found), deps, listed, _union(refused))
