"""Vulnerability feeds as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade import schemas


def read_advisories(spark: SparkSession, path: str, per: str = "line") -> DataFrame:
    """Advisory dump: one JSON document per line, or with `per` "file" one per file, however it is laid out.

    Documents without an id, which includes text that does not parse, are left out; `nameless_advisories` lists them.
    """
    return _advisories(spark, path, per).filter(F.col("id").isNotNull()).drop("_broken", "_file")


def nameless_advisories(spark: SparkSession, path: str, per: str = "line") -> DataFrame:
    """What `read_advisories` leaves out: file, reason."""
    rows = _advisories(spark, path, per).select("id", "_broken", F.col("_file").alias("file")).filter(F.col("id").isNull())
    return rows.select("file", F.when(F.col("_broken").isNotNull(), "no JSON").otherwise("no id").alias("reason"))


def _advisories(spark: SparkSession, path: str, per: str) -> DataFrame:
    if per not in ("line", "file"):
        raise ValueError(f"advisories per {per!r}: line or file")
    reader = spark.read.schema(schemas.ADVISORY + ", _broken string").option("columnNameOfCorruptRecord", "_broken")
    return reader.json(path, multiLine=per == "file").withColumn("_file", F.col("_metadata.file_path"))


def last_per_id(rows: DataFrame, id_column: str = "cve_id", position: str = "position") -> DataFrame:
    """Upper-case ids, empty ids dropped, the last row in feed order kept for each id."""
    last_first = W.partitionBy(id_column).orderBy(F.col(position).desc())
    return (
        rows.filter(F.coalesce(F.col(id_column), F.lit("")) != "")
        .withColumn(id_column, F.upper(id_column))
        .withColumn("_rank", F.row_number().over(last_first))
        .filter("_rank = 1")
        .drop("_rank", position)
    )


def kev_rows(feed: DataFrame, *order: str) -> DataFrame:
    """Known-exploited feed documents as rows: cve_id, product, short_description.

    `order` names the columns that put several documents in order, the last one winning.
    """
    rows = feed.select(*order, F.posexplode("vulnerabilities").alias("_i", "v")).select(
        F.struct(*order, "_i").alias("position"),
        F.col("v.cveID").alias("cve_id"),
        F.col("v.product").alias("product"),
        F.col("v.shortDescription").alias("short_description"),
    )
    return last_per_id(rows)


def epss_rows(feed: DataFrame, *order: str) -> DataFrame:
    """Exploit-probability documents as rows; a number that does not parse gives null."""
    rows = feed.select(*order, F.posexplode("data").alias("_i", "d")).select(
        F.struct(*order, "_i").alias("position"),
        F.col("d.cve").alias("cve_id"),
        F.col("d.epss").try_cast("double").alias("epss"),
        F.col("d.percentile").try_cast("double").alias("percentile"),
    )
    return last_per_id(rows)


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    return kev_rows(spark.read.schema(schemas.KEV_FEED).json(path, multiLine=True))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    return epss_rows(spark.read.schema(schemas.EPSS_FEED).json(path, multiLine=True))
