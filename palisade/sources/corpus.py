"""Files of many scans as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import has_excluded_dir, is_uploadable

# The largest file that fits into a row; larger ones are read by `large.read_chunks`.
MAX_BYTES = 2**31 - 1024


def repaired_text(content: Column) -> Column:
    """Bytes as text, bad sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def read_corpus(spark: SparkSession, root: str, scan_id: str | None = None, glob: str | None = None) -> DataFrame:
    """One row per file below `root`: scan_id, path, relative_path, content, size_bytes.

    Without `scan_id` the first folder below the root names the scan. `glob` is applied while
    listing, so that files it leaves out are never opened. Bytes that are no UTF-8 are replaced.
    Files above MAX_BYTES are left out: `large.read_chunks` reads them, `oversized_files` lists them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return corpus_rows(reader.load(root).filter(F.col("length") <= MAX_BYTES), root, scan_id)


def oversized_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, size_bytes of files that do not fit into a row and that `read_corpus` leaves out.

    Only sizes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.filter(F.col("length") > max_bytes).select("path", F.col("length").alias("size_bytes"))


def placed_path(file: Column, root: str, scan_id: str | None = None) -> tuple[Column, Column, Column]:
    """Scan, path and path below `root` of a file; without `scan_id` the first folder names the scan."""
    base = root.rstrip("/") + "/"
    plain = F.regexp_replace(file, "^file:/+", "/")
    relative = F.substr(plain, F.instr(plain, base) + len(base))
    return (F.lit(scan_id) if scan_id else F.substring_index(relative, "/", 1)), plain, relative


def corpus_rows(files: DataFrame, root: str, scan_id: str | None = None) -> DataFrame:
    """Shape binaryFile rows (batch or stream) as corpus rows."""
    scan, plain, relative = placed_path(F.col("path"), root, scan_id)
    return files.select(
        scan.alias("scan_id"),
        plain.alias("path"),
        relative.alias("relative_path"),
        repaired_text(F.col("content")).alias("content"),
        F.col("length").alias("size_bytes"),
    )


def exclude_dirs(files: DataFrame, which: str, column: str = "relative_path") -> DataFrame:
    """Drop files below a skipped folder. `which`: config, manifest or upload."""
    return files.filter(~has_excluded_dir(F.col(column), which))


def upload_filter(files: DataFrame, column: str = "relative_path", size: str = "size_bytes") -> DataFrame:
    """Keep what an upload would send."""
    return files.filter(is_uploadable(F.col(column), F.col(size)))
