"""Where queries and their SQL are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import TABLES, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _busy_splits(df: DataFrame, cores: int) -> int:
    """Splits of a table that have rows: a file may be one row group, which one task reads. They are counted, from the
    files' footers, only if there are as many splits as cores."""
    splits = df.rdd.getNumPartitions()
    return splits if splits < cores else df.select(F.spark_partition_id()).distinct().count()


class Inputs:
    """The given tables and the views over them, as DataFrames: `t.v_findings`, `t.lineitem`.

    `t.busy` gives the same tables spread over all cores where a file has fewer splits than that,
    for queries that work hard on every row.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.spread_rows = spread_rows

    @property
    def busy(self) -> Inputs:
        return Inputs(self.spark, self.sf_dir, spread_rows=True)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            cores = self.spark.sparkContext.defaultParallelism
            return df.repartition(2 * cores) if self.spread_rows and _busy_splits(df, cores) < cores else df
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over table and view names."""

        def on_file(match: re.Match) -> str:
            word, table = match.groups()
            if not self.spread_rows:
                return f"{word} parquet.`{self.sf_dir}/{table}.parquet`"
            getattr(self, table).createOrReplaceTempView(f"busy_{table}")
            return f"{word} busy_{table}"

        return self.spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", on_file, with_views(text)))


def _used_views(text: str) -> list[str]:
    """Views a text needs, those they need first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            for inner in _used_views(VIEWS[name]):
                if inner not in out:
                    out.append(inner)
            if name not in out:
                out.append(name)
    return out


def with_views(text: str) -> str:
    """The text with the views it names as common table expressions."""
    names = _used_views(text)
    if not names:
        return text
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = text.strip()
    head = re.match(r"(?is)^WITH( RECURSIVE)?\s+", body)
    if head:
        return f"WITH{head.group(1) or ''} {ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"


def query(sql: str | None = None):
    """Register a function of `Inputs` under its own name."""

    def register(fn: Callable[[Inputs], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
