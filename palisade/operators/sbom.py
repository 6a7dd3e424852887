"""Packages of a bill of materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import purl
from palisade.functions.base import strip, text_after, text_before

PACKAGE_COLUMNS = ["scan_id", "name", "version", "ecosystem", "license", "purl"]


def sbom_packages(deps: DataFrame, default_license: str | None = None) -> DataFrame:
    """Packages of resolved dependencies; a licence that is not known stays null unless a default is given."""
    known = F.col("license") if "license" in deps.columns else F.lit(None).cast("string")
    return deps.select(
        "scan_id", "name", "version", "ecosystem",
        F.coalesce(known, F.lit(default_license).cast("string")).alias("license"),
        purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"),
    )


def sbom_from_findings(scans: DataFrame, findings: DataFrame, order: list[str]) -> DataFrame:
    """Packages guessed from dependency findings, for scans without a stored list.

    The first row (by `order`) of each name counts; a scan without any gets one row for itself.
    A list stored in the scan's `metadata_json` wins.
    """
    stored = None
    if "metadata_json" in scans.columns:
        stored = _stored_packages(scans)
        scans = scans.join(stored.select("scan_id").distinct(), "scan_id", "left_anti")
    evidence = F.coalesce("evidence", F.lit(""))
    pinned = F.contains(evidence, F.lit("=="))
    whole = strip(evidence)
    name = F.when(pinned, strip(text_before(evidence, "=="))).otherwise(
        F.when(whole == "", "unknown").otherwise(whole)
    )
    version = F.when(pinned, strip(text_after(evidence, "=="))).otherwise("0.0.0")
    first = W.partitionBy("scan_id", "name").orderBy(*order)
    packages = (
        findings.filter("category = 'cve'")
        .withColumns({"name": name, "version": version})
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .join(scans.select("scan_id"), "scan_id", "left_semi")
        .select(
            "scan_id", "name", "version", F.lit("pypi").alias("ecosystem"),
            F.lit(None).cast("string").alias("license"),
            purl(F.lit("pypi"), F.col("name"), F.col("version")).alias("purl"),
        )
    )
    last = F.substring_index(F.regexp_replace("target", "/+$", ""), "/", -1)
    itself = scans.join(
        findings.filter("category = 'cve'").select("scan_id").distinct(), "scan_id", "left_anti"
    ).select(
        "scan_id",
        F.when(last == "", "project").otherwise(last).alias("name"),
        F.lit("0.0.0").alias("version"),
        F.lit("pypi").alias("ecosystem"),
        F.lit("MIT").alias("license"),
        F.lit(None).cast("string").alias("purl"),
    )
    rows = packages.unionByName(itself)
    return rows if stored is None else rows.unionByName(stored)


def _stored_packages(scans: DataFrame) -> DataFrame:
    shape = "sbom struct<packages:array<struct<name:string,version:string,ecosystem:string,license:string,purl:string>>>"
    return scans.select("scan_id", F.inline(F.from_json("metadata_json", shape)["sbom"]["packages"]))
