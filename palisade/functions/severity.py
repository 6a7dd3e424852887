"""Severity names, scores and the numbers hung on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.base import pick, strip, thresholds

# Spellings of the five levels.
SPELLINGS = {
    "critical": ["critical", "crit"],
    "high": ["high", "h"],
    "medium": ["medium", "med", "moderate"],
    "low": ["low", "l"],
}
# Numbers per level, one table per use.
BASE_SCORE = {"critical": 9.5, "high": 7.5, "medium": 5.0, "low": 2.5, "info": 0.5}
ADVISORY_SCORE = {"critical": 9.5, "high": 8.0, "medium": 5.5, "low": 2.5}
DASHBOARD_WEIGHT = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 0.5, "info": 0.1}
SCAN_RISK_WEIGHT = {"critical": 25, "high": 15, "medium": 7, "low": 2}
HEALTH_PENALTY = {"critical": 15, "high": 8, "medium": 2}
RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
# Weights of vector parts for the rough estimate.
VECTOR_WEIGHTS = {
    "AV:N": 1.5, "AV:A": 1.0, "AV:L": 0.5, "AV:P": 0.2,
    "AC:L": 1.0, "AC:H": 0.5,
    "PR:N": 1.0, "PR:L": 0.7, "PR:H": 0.3,
    "UI:N": 1.0, "UI:R": 0.5,
    "C:H": 1.5, "C:L": 0.5,
    "I:H": 1.5, "I:L": 0.5,
    "A:H": 1.5, "A:L": 0.5,
}
# Severity words of the two analysers.
ANALYSER_SEVERITY = {
    "semgrep": {"ERROR": "high", "WARNING": "medium", "INFO": "low"},
    "bandit": {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"},
}
URGENCY = {
    "immediate": "Patch immediately or isolate affected component.",
    "high": "Plan patch for the next scheduled deployment window.",
    "scheduled": "Remediate as part of routine maintenance.",
    "monitor": "Monitor for changes in threat status.",
}


def normalize_severity(c: Column) -> Column:
    """One of the five levels for any spelling; unknown and null give info."""
    word = F.lower(strip(c))
    expr = F.when(word.isin(SPELLINGS["critical"]), "critical")
    for level in ("high", "medium", "low"):
        expr = expr.when(word.isin(SPELLINGS[level]), level)
    return expr.otherwise("info")


def score_to_severity(c: Column) -> Column:
    """Level of a final score."""
    return thresholds(c, [(9, "critical"), (7, "high"), (4, "medium"), (1, "low")], "info")


def cvss_to_severity(c: Column) -> Column:
    """Level of a vulnerability score."""
    return thresholds(c, [(9, "critical"), (7, "high"), (4, "medium"), (0.1, "low")], "info")


def cvss_vector_estimate(vector: Column) -> Column:
    """Rough score of a vector: the sum of the parts found as substrings, clipped to 0..10.

    An estimate only. `AC:L` contains `C:L` and so counts for both, as the published numbers expect.
    """
    total = F.lit(0.0)
    for part, weight in VECTOR_WEIGHTS.items():
        total = total + F.when(vector.contains(part), weight).otherwise(0.0)
    return F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), total)), 1)


def map_sast_severity(tool: Column, word: Column) -> Column:
    """Level of an analyser's severity word."""
    upper = F.upper(word)
    return (
        F.when(tool == "semgrep", pick(upper, ANALYSER_SEVERITY["semgrep"], "low"))
        .when(tool == "bandit", pick(upper, ANALYSER_SEVERITY["bandit"], "low"))
        .otherwise("low")
    )


def count_bucket(severity: Column) -> Column:
    """Counter a level belongs to: info and unknown words count as low."""
    return F.when(severity.isin("critical", "high", "medium"), severity).otherwise("low")


def severity_rank(severity: Column) -> Column:
    return pick(severity, RANK, 0)


def sarif_level(severity: Column) -> Column:
    return pick(severity, SARIF_LEVEL, "note")


def risk_label(score: Column) -> Column:
    """Label of a 0..100 scan risk (limits exclusive)."""
    return (
        F.when(score > 80, "Critical").when(score > 50, "High").when(score > 20, "Moderate").otherwise("Low")
    )


def compliance_label(score: Column) -> Column:
    return thresholds(score, [(85, "Strong"), (65, "Needs Review")], "High Risk")


def priority(known_exploited: Column, epss: Column, cvss: Column) -> Column:
    """Order of work from exploitation, exploit probability and score; nulls count as zero."""
    p, s = F.coalesce(epss, F.lit(0.0)), F.coalesce(cvss, F.lit(0.0))
    return (
        F.when(F.coalesce(known_exploited, F.lit(False)) | (p >= 0.70), "immediate")
        .when((p >= 0.30) | (s >= 8.0), "high")
        .when((p >= 0.05) | (s >= 5.0), "scheduled")
        .otherwise("monitor")
    )


def urgency(prio: Column) -> Column:
    return pick(prio, URGENCY, URGENCY["monitor"])
