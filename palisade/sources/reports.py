"""JSON reports of static analysers, one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.corpus import repaired_text


def read_sast_reports(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """Report documents with the tool that wrote them: scan_id, tool, document.

    The folder above a report names the scan. Feed the rows to `operators.analysers`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option(
        "recursiveFileLookup", "true"
    ).load(path)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("scan_id"),
        F.lit(tool).alias("tool"),
        repaired_text(F.col("content")).alias("document"),
    )
