"""Writers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.schemas import SCAN_STATUSES


def write_findings(df: DataFrame, path: str, mode: str = "append") -> None:
    """Findings as parquet, one folder per category. Categories are few, so folders stay few."""
    df.write.mode(mode).partitionBy("category").parquet(path)


def write_scans(df: DataFrame, path: str, mode: str = "append") -> None:
    """Scans as parquet, one folder per status; an unknown status stops the job."""
    known = F.col("status").isin(SCAN_STATUSES)
    checked = df.withColumn(
        "status",
        F.when(known, F.col("status")).otherwise(
            F.raise_error(F.concat(F.lit("unknown scan status "), F.coalesce("status", F.lit("null"))))
        ),
    )
    checked.write.mode(mode).partitionBy("status").parquet(path)
