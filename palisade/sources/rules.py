"""Rules, baselines and secret patterns as small tables, built in or read from files.

Rule files are configuration: a few hundred entries, parsed on the driver like any job parameter. Whether a pattern
can run is for the JVM to say, which runs it: readers leave out what it refuses, and `refused_entries` lists that.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import schemas
from palisade.operators.common import refusal, small_rows
from palisade.sources import builtin


def _documents(spark: SparkSession, path: str) -> list[tuple[str, object]]:
    """Name without suffix and content of the YAML or JSON files below a path, in path order.

    Read through Spark, so that any file system works. Files that do not parse are left out.
    """
    import yaml

    texts = spark.read.text(
        path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,yml,json}"
    ).select(F.col("_metadata.file_path").alias("path"), "value")
    documents = []
    for row in sorted(small_rows(texts), key=lambda r: r.path):
        stem = re.sub(r"\.[^.]*$", "", row.path.rsplit("/", 1)[-1])
        try:
            documents.append((stem, yaml.safe_load(row.value)))
        except yaml.YAMLError:
            continue
    return documents


def _entries(document) -> Iterable[dict]:
    """The entries of any of the three shapes: one mapping, a list, or a mapping with `rules`."""
    if isinstance(document, dict):
        document = document.get("rules", [document])
    return [e for e in document or [] if isinstance(e, dict)]


def rule_rows(entries: Iterable[dict]) -> list[dict]:
    """Complete enabled entries with the defaults filled in."""
    rows = []
    for e in entries:
        if not {"id", "name", "pattern"} <= e.keys() or not e.get("enabled", True):
            continue
        if not isinstance(e["pattern"], str):
            continue
        rows.append(
            {
                "rule_id": e["id"],
                "name": e["name"],
                "description": e.get("description", ""),
                "severity": str(e.get("severity", "medium")).lower(),
                "category": str(e.get("category", "misconfiguration")).lower(),
                "pattern": e["pattern"],
                "file_types": list(e.get("file_types", ["*"])),
                "remediation": e.get("remediation", ""),
                "references": list(e.get("references", [])),
                "tags": list(e.get("tags", [])),
            }
        )
    return rows


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file or folder of YAML or JSON files; incomplete and disabled ones are left out, and those whose
    pattern the JVM refuses."""
    rows = [r for _, document in _documents(spark, path) for r in rule_rows(_entries(document))]
    return spark.createDataFrame([r for r in rows if refusal(spark, r["pattern"]) is None], schemas.RULE)


def refused_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of rule or pattern files whose pattern cannot run: file, name, pattern, reason."""
    rows = []
    for stem, document in _documents(spark, path):
        for e in _entries(document):
            if {"name", "pattern"} <= e.keys():
                reason = refusal(spark, e["pattern"]) if isinstance(e["pattern"], str) else "no text"
                rows += [(stem, str(e["name"]), str(e["pattern"]), reason)] if reason else []
    return spark.createDataFrame(rows, "file string, name string, pattern string, reason string")


def builtin_rules(spark: SparkSession, id_prefix: str = "") -> DataFrame:
    """The shipped rules. `id_prefix` goes in front of the ids that are not banking ids."""
    return spark.createDataFrame(rule_rows(builtin.rules(id_prefix)), schemas.RULE)


def _check_row(config_type: str, stem: str, e: dict) -> dict:
    return {
        "config_type": config_type,
        "check_id": e.get("id", f"CUSTOM-{stem}"),
        "name": e.get("name", "Custom Check"),
        "description": e.get("description", ""),
        "severity": e.get("severity", "medium"),
        "check_type": e.get("check_type", "must_not_match"),
        "pattern": e.get("pattern", ""),
        "remediation": e.get("remediation", ""),
        "tags": list(e.get("tags", [])),
    }


def builtin_baselines(spark: SparkSession) -> DataFrame:
    """The shipped checks of the four configuration types."""
    rows = [_check_row(kind, kind, e) for kind, checks in builtin.BASELINES.items() for e in checks]
    return spark.createDataFrame(rows, schemas.CHECK)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Shipped checks plus those of `{config_type, checks: [...]}` files, which extend or add a type."""
    rows = []
    for stem, document in _documents(spark, path):
        if not isinstance(document, dict):
            continue
        kind = document.get("config_type", stem)
        rows += [_check_row(kind, stem, e) for e in document.get("checks", [])]
    return builtin_baselines(spark).unionByName(spark.createDataFrame(rows, schemas.CHECK))


def builtin_secret_patterns(spark: SparkSession) -> DataFrame:
    """Demo patterns; the original set is not public. Add your own rows with `union`."""
    return spark.createDataFrame(builtin.SECRET_PATTERNS, schemas.SECRET_PATTERN)


def read_secret_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Shipped patterns plus the entries of YAML or JSON files (name, pattern, severity, ...)."""
    rows = [
        {
            "name": e["name"],
            "pattern": e["pattern"],
            "severity": e.get("severity", "high"),
            "description": e.get("description", ""),
            "tags": list(e.get("tags", [])),
        }
        for _, document in _documents(spark, path)
        for e in _entries(document)
        if {"name", "pattern"} <= e.keys() and isinstance(e["pattern"], str) and refusal(spark, e["pattern"]) is None
    ]
    return builtin_secret_patterns(spark).unionByName(spark.createDataFrame(rows, schemas.SECRET_PATTERN))
