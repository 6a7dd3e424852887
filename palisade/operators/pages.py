"""Pages of a long list without counting it: rows stored in order, with their places.

The rows are sorted by range into files, the newest first, and each keeps its file's number and its place there. An
index holds the number of rows of each file. A page is then a run of places in one or two files, and row groups that
hold none of them are skipped by their smallest and largest place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = (1 << 33) - 1


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the next one begins behind this place."""

    part: int = 0
    place: int = -1


def write_pages(df: DataFrame, path: str, id_column: str, time_column: str = "created_at") -> None:
    """Store `df` in the order of pages: the newest first, equal times by id."""
    order = [F.col(time_column).desc(), F.col(id_column)]
    row = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", row)
    placed = ordered.withColumns({"_part": F.shiftright("_row", 33).cast("int"), "_place": F.col("_row").bitwiseAND(F.lit(PLACE))}).drop("_row")
    base = path.rstrip("/")
    placed.write.mode("overwrite").parquet(f"{base}/rows")
    rows = df.sparkSession.read.parquet(f"{base}/rows")
    rows.groupBy("_part").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{base}/index")


def _index(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Part and number of rows, in order: a row for each file."""
    return [(r["_part"], r["n"]) for r in spark.read.parquet(f"{path.rstrip('/')}/index").orderBy("_part").collect()]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.orderBy("_part", "_place").drop("_part", "_place")


def read_page(spark: SparkSession, path: str, page: int = 1, per_page: int = 20) -> DataFrame:
    """A page by its number, from 1; behind the last one there are no rows."""
    first, wanted, before = (page - 1) * per_page, F.lit(False), 0
    for part, n in _index(spark, path):
        low, high = max(first - before, 0), min(first + per_page - before, n) - 1
        if low <= high:
            wanted |= (F.col("_part") == part) & F.col("_place").between(low, high)
        before += n
    return _shown(spark.read.parquet(f"{path.rstrip('/')}/rows").filter(wanted))


def next_page(spark: SparkSession, path: str, condition: Column, after: Cursor | None = None, per_page: int = 20) -> tuple[DataFrame, Cursor | None]:
    """The rows that pass a condition, from behind a cursor on, and the cursor for the page behind them; None if this is
    the last. Files are opened from the cursor on, twice as many in each step, until the page is full."""
    after = after or Cursor()
    rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
    behind = (F.col("_part") > after.part) | ((F.col("_part") == after.part) & (F.col("_place") > after.place))
    parts = [part for part, _ in _index(spark, path) if part >= after.part]
    step, at, found = 1, 0, []
    while at < len(parts) and len(found) <= per_page:
        some = parts[at : at + step]
        here = rows.filter(F.col("_part").between(some[0], some[-1]) & behind & condition).orderBy("_part", "_place").limit(per_page + 1 - len(found))
        found += [(r["_part"], r["_place"]) for r in here.select("_part", "_place").collect()]  # a page at most
        at, step = at + step, step * 2
    if not found:
        return _shown(rows.limit(0)), None
    last = found[: per_page][-1]
    until = (F.col("_part") < last[0]) | ((F.col("_part") == last[0]) & (F.col("_place") <= last[1]))
    near = F.col("_part").between(found[0][0], last[0])
    return _shown(rows.filter(near & behind & until & condition)), Cursor(*last) if len(found) > per_page else None
