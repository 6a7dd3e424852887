"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Stored


def _nearest(links: DataFrame) -> DataFrame:
    """Every link seen from `a`, with the smallest of `a` and its partners. The minimum is taken before the join, and
    its side has one row for each node, so a node with very many links can be split."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    return links.join(least.select(F.col("a").alias("node"), F.least("node", "least").alias("m")), F.col("a") == F.col("node")).drop("node")


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b: long) to (node, component): the smallest node reachable, for all nodes with a link.

    Alternating large and small stars: every round hangs larger neighbours, then smaller ones, on the smallest
    node known, until nothing changes (a number of rounds that grows with the logarithm of the nodes). Rounds are
    stored tables; the one before is removed as soon as the next is written."""
    now = Stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _nearest(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        step = Stored(large)
        down = step.df.groupBy("a").agg(F.min("b").alias("m"))
        seen = step.df.join(down.withColumnRenamed("a", "node"), F.col("a") == F.col("node"))
        small = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        after = Stored(small.filter("a <> b").distinct())
        now.drop()
        step.drop()
        now = after
        row = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    roots = now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
