"""Roll-ups over all scans, and per-scan report numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import risk_label, severity_rank
from palisade.functions.base import pick
from palisade.functions.severity import DASHBOARD_WEIGHT, HEALTH_PENALTY, SCAN_RISK_WEIGHT
from palisade.operators.findings import newest_first
from palisade.schemas import SEVERITIES

# Factor and lowest score of each framework's health.
HEALTH = [("RBI-CSF", 1.1, 15), ("NIST-CSF", 0.9, 20), ("SOC-2", 1.05, 18), ("OWASP-10", 1.25, 10)]
# Sentences of the summary.
SUMMARY_CLEAN = (
    "No active findings were detected in the scanned target. "
    "The application satisfies all primary {tool} vulnerability checks."
)
SUMMARY_SERIOUS = "This scan identified {n} high-priority security risks that should be reviewed before release."
SUMMARY_BY_CATEGORY = {
    "secret": "Credential exposure risk was detected in source or configuration files. Exposed tokens represent immediate access hazards.",
    "cve": "Known vulnerable dependencies were found in project manifests. Legacy packages should be updated to address known exploits.",
    "misconfig": "Configuration weaknesses may increase production exposure. Review deployment baselines to prevent environment leakage.",
}


def half_up(c: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(c + 0.5).cast("bigint")


def _level(c: str = "severity") -> Column:
    """Severity in lower case; unknown words are info."""
    word = F.lower(c)
    return F.when(word.isin(SEVERITIES), word).otherwise("info")


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n: always five rows. One row is aggregated and unfolded, so nothing is joined."""
    one = findings.agg(*[F.count_if(_level() == s).alias(s) for s in SEVERITIES])
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES]))
    )


def severity_share(findings: DataFrame) -> DataFrame:
    """severity_counts with the share of all and whole percent."""
    total = F.sum("n").over(W.partitionBy())
    share = F.col("n") / F.greatest(total, F.lit(1))
    return severity_counts(findings).select(
        "severity", "n", F.round(share, 6).alias("share"), half_up(share * 100).alias("percent")
    )


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n"))


def dashboard_totals(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: number of scans and of findings."""
    counted = scans.agg(F.count("*").alias("n")).withColumn("what", F.lit("total_scans")).unionByName(
        findings.agg(F.count("*").alias("n")).withColumn("what", F.lit("total_findings"))
    )
    return counted.agg(
        *[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("total_scans", "total_findings")]
    )


def recent_scans(scans: DataFrame, n: int = 10) -> DataFrame:
    return newest_first(scans, "scan_id").limit(n)


def top_vulnerabilities(findings: DataFrame, n: int = 5) -> DataFrame:
    keys = ["rule_id", "title", "severity", "category"]
    return findings.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *keys).limit(n)


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00")


def trend_sums() -> list[Column]:
    return [F.coalesce(F.sum(f"{s}_count"), F.lit(0)).alias(s) for s in SEVERITIES[:4]]


def hourly_trend(scans: DataFrame, hours: int = 30, latest: bool = False) -> DataFrame:
    """Counters of completed scans by hour (UTC), the oldest `hours` hours; `latest` takes the newest."""
    by_hour = (
        scans.filter("status = 'completed'").groupBy(hour_label(F.col("created_at")).alias("hour")).agg(*trend_sums())
    )
    if latest:
        by_hour = by_hour.orderBy(F.col("hour").desc()).limit(hours)
    return by_hour.orderBy("hour").limit(hours)


def pad_trend(trend: DataFrame) -> DataFrame:
    """A trend of a single point gets a zero row `Start`. At most a few rows, after the limit."""
    zero = F.struct(
        F.lit("Start").alias("hour"), *[F.lit(0).cast("bigint").alias(s) for s in SEVERITIES[:4]]
    )
    point = F.struct("hour", *SEVERITIES[:4])
    alone = F.count("*").over(W.partitionBy()) == 1
    return trend.withColumn("_alone", alone).select(
        F.inline(F.when(F.col("_alone"), F.array(zero, point)).otherwise(F.array(point)))
    )


def _weighted(weights: dict) -> Column:
    return F.sum(pick(F.col("severity"), weights, 0 if isinstance(next(iter(weights.values())), int) else 0.0))


def risk_score(findings: DataFrame) -> DataFrame:
    """One row: weighted number of findings, at most 100.

    Counts are added before they are weighted, so that the order of rows cannot change the sum.
    """
    raw = F.lit(0.0)
    for level, weight in DASHBOARD_WEIGHT.items():
        raw = raw + F.col(level) * F.lit(weight)
    one = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return one.select(F.least(F.round(raw, 1), F.lit(100.0)).alias("risk_score"))


def scan_risk(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Per scan: weighted findings up to 100, and the label. Give `scans` to include empty ones."""
    raw = findings.groupBy("scan_id").agg(_weighted(SCAN_RISK_WEIGHT).alias("_raw"))
    if scans is not None:
        raw = scans.select("scan_id").join(raw, "scan_id", "left").fillna(0, ["_raw"])
    return raw.select("scan_id", F.least("_raw", F.lit(100)).cast("int").alias("risk")).withColumn(
        "label", risk_label(F.col("risk"))
    )


def framework_health(findings: DataFrame, *by: str) -> DataFrame:
    """framework, score: four rows from one aggregate, over everything or per group (`scan_id`)."""
    one = findings.groupBy(*by).agg(F.coalesce(_weighted(HEALTH_PENALTY), F.lit(0)).alias("_penalty"))
    rows = [
        F.struct(
            F.lit(name).alias("framework"),
            F.greatest(
                F.lit(floor), F.least(F.lit(100), half_up(100 - F.col("_penalty") * F.lit(factor)))
            ).alias("score"),
        )
        for name, factor, floor in HEALTH
    ]
    return one.select(*by, F.inline(F.array(*rows)))


def executive_summary(scans: DataFrame, findings: DataFrame, tool: str = "Palisade") -> DataFrame:
    """scan_id, summary: sentences by what the findings of the scan are."""
    category = F.lower("category")
    facts = findings.groupBy("scan_id").agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("_serious"),
        *[F.bool_or(category == c).alias(f"_{c}") for c in SUMMARY_BY_CATEGORY],
    )
    before, after = SUMMARY_SERIOUS.split("{n}")
    sentences = [
        F.when(
            F.col("_serious") > 0,
            F.concat(F.lit(before), F.col("_serious").cast("string"), F.lit(after)),
        )
    ] + [F.when(F.col(f"_{c}"), F.lit(text)) for c, text in SUMMARY_BY_CATEGORY.items()]
    text = F.when(F.col("_serious").isNull(), SUMMARY_CLEAN.format(tool=tool)).otherwise(
        F.concat_ws(" ", *sentences)
    )
    return scans.select("scan_id").join(facts, "scan_id", "left").select("scan_id", text.alias("summary"))


def remediation_buckets(findings: DataFrame) -> DataFrame:
    """Per scan three rows: bucket (now, sprint, backlog), n, categories in upper case or `None`."""
    bucket = (
        F.when(F.col("severity").isin("critical", "high"), "now")
        .when(F.col("severity") == "medium", "sprint")
        .otherwise("backlog")
    )
    # counted per category first: what is left is at most buckets x categories per scan
    counted = findings.groupBy("scan_id", bucket.alias("bucket"), F.upper("category").alias("category")).agg(
        F.count("*").alias("n")
    )
    names = ["now", "sprint", "backlog"]
    of = lambda b, c: F.when(F.col("bucket") == b, F.col(c))
    wide = counted.groupBy("scan_id").agg(
        *[F.coalesce(F.sum(of(b, "n")), F.lit(0)).alias(f"_{b}") for b in names],
        *[F.sort_array(F.collect_set(of(b, "category"))).alias(f"_{b}_categories") for b in names],
    )
    rows = [
        F.struct(
            F.lit(b).alias("bucket"),
            F.col(f"_{b}").alias("n"),
            F.when(F.size(f"_{b}_categories") > 0, F.array_join(f"_{b}_categories", ", "))
            .otherwise("None")
            .alias("categories"),
        )
        for b in names
    ]
    return wide.select("scan_id", F.inline(F.array(*rows)))


def risk_points(records: bool = True) -> Column:
    """Points of one finding from its level and, if joined, from intelligence."""
    points = severity_rank(F.col("severity")) * 10
    if records:
        points = (
            points
            + F.when(F.col("known_exploited"), 100).otherwise(0)
            + F.when(F.col("priority") == "immediate", 80).when(F.col("priority") == "high", 50).otherwise(0)
            + F.when(F.col("epss") >= 0.7, 40).otherwise(0)
        )
    return points


def top_risks(findings: DataFrame, records: DataFrame, n: int = 5, in_place: bool = False) -> DataFrame:
    """The n findings with most points per scan: `points` and `place` added; ties go by finding_id.

    Findings without a CVE get a join key of their own, so they do not all meet in one task. `in_place`: findings are
    `dealt` by scan and stay there; only the pairs of scan and CVE go to the records and come back with them.
    """
    intel = records.select(F.col("cve_id").alias("_cve"), "known_exploited", "priority", "epss")
    if in_place:
        joined = _with_records_in_place(findings, intel)
    else:
        key = F.coalesce(F.upper("cve_id"), F.concat(F.lit("#"), F.col("finding_id")))
        joined = findings.withColumn("_cve", key).join(intel, "_cve", "left")
    rated = joined.withColumn("points", risk_points()).select(*findings.columns, "points")
    best = W.partitionBy("scan_id").orderBy(F.col("points").desc(), "finding_id")
    return rated.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


def _with_records_in_place(findings: DataFrame, intel: DataFrame) -> DataFrame:
    """The left join of findings, `dealt` by scan, with the records of their CVE.

    A join by scan and CVE would deal the findings again. Records are put before the findings of their scan and CVE
    instead, and a running window hands them on.
    """
    cve = F.upper("cve_id").alias("_cve")
    pairs = findings.select("scan_id", cve).filter(F.col("_cve").isNotNull()).distinct()
    known = [c for c in intel.columns if c != "_cve"]
    # a list, as a CVE may have several records
    back = pairs.join(intel, "_cve").groupBy("scan_id", "_cve").agg(F.collect_list(F.struct(*known)).alias("_records"))
    before = back.repartition("scan_id").withColumn("_is_finding", F.lit(False))
    both = before.unionByName(findings.select("*", cve, F.lit(True).alias("_is_finding")), allowMissingColumns=True)
    run = W.partitionBy("scan_id", "_cve").orderBy("_is_finding").rowsBetween(W.unboundedPreceding, 0)
    handed = both.withColumn("_known", F.first("_records", ignorenulls=True).over(run)).filter("_is_finding")
    return handed.select(*findings.columns, F.inline_outer("_known"))


def activity_feed(scans: DataFrame, findings: DataFrame, audit: DataFrame) -> DataFrame:
    """One list of events, the newest first: scans, fixes, serious findings, audit rows."""
    columns = ["id", "action", "target", "timestamp", "status"]
    parts = [
        scans.select(
            F.concat(F.lit("scan-"), "scan_id").alias("id"),
            F.concat(F.lit("Vulnerability scan completed ("), "scan_type", F.lit(")")).alias("action"),
            "target",
            F.coalesce("completed_at", "created_at").alias("timestamp"),
            F.when(F.col("status") == "failed", "error").otherwise("success").alias("status"),
        ),
        findings.filter("is_fixed").select(
            F.concat(F.lit("fix-"), "finding_id").alias("id"),
            F.concat(F.lit("Applied Auto-Fix patch for "), "title").alias("action"),
            F.concat("file_path", F.lit(":L"), F.col("line_number").cast("string")).alias("target"),
            F.col("created_at").alias("timestamp"),
            F.lit("success").alias("status"),
        ),
        findings.filter(~F.col("is_fixed") & F.col("severity").isin("critical", "high")).select(
            F.concat(F.lit("vuln-"), "finding_id").alias("id"),
            F.concat(F.upper("severity"), F.lit(" vulnerability detected")).alias("action"),
            F.concat("title", F.lit(" in "), "file_path").alias("target"),
            F.col("created_at").alias("timestamp"),
            F.lit("warning").alias("status"),
        ),
        audit.select(
            F.concat(F.lit("audit-"), "audit_id").alias("id"),
            F.concat(
                "action", F.lit(" (Operator: "), "operator", F.lit(') — Justification: "'),
                F.coalesce("justification", F.lit("None")), F.lit('"'),
            ).alias("action"),
            F.coalesce("target", F.lit("System")).alias("target"),
            "timestamp",
            "status",
        ),
    ]
    feed = parts[0]
    for part in parts[1:]:
        feed = feed.unionByName(part)
    return feed.select(*columns).orderBy(F.col("timestamp").desc(), "id")


def audit_log(audit: DataFrame) -> DataFrame:
    return audit.orderBy(F.col("timestamp").desc(), "audit_id")


def scan_metadata(scans: DataFrame, manifests: DataFrame, deps: DataFrame, n_rules: int) -> DataFrame:
    """Per scan: number of manifests and dependencies, rules loaded (only where rules run).

    The manifest names stay rows: see `scanned_manifests`.
    """
    m = manifests.groupBy("scan_id").agg(F.count("*").alias("manifests_scanned"))
    d = deps.groupBy("scan_id").agg(F.count("*").alias("dependencies"))
    rules = F.when(F.col("scan_type").isin("full", "misconfig"), n_rules).otherwise(0)
    return (
        scans.select("scan_id", "scan_type")
        .join(m, "scan_id", "left")
        .join(d, "scan_id", "left")
        .fillna(0, ["manifests_scanned", "dependencies"])
        .withColumn("rules_loaded", rules)
    )


def scanned_manifests(manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """scan_id, manifest: paths relative to the scan root where they lie below it."""
    below = F.startswith("path", F.concat("root", F.lit("/")))
    relative = F.when(below, F.substr("path", F.length("root") + 2)).otherwise(F.col("path"))
    return manifests.join(roots, "scan_id").select("scan_id", relative.alias("manifest"))
