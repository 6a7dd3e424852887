"""Scan targets that point into a branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import is_public_address, is_webhook_url
from palisade.functions.base import text_after, text_before
from palisade.functions.texts import url_host

# What separates repository and branch in a URL, in the order tried.
TREE_MARKS = ["/-/tree/", "/tree/", "/src/"]


def branch_of_url(targets: DataFrame, branches: DataFrame) -> DataFrame:
    """Repository, branch and subpath of each target.

    `targets`: target, branch (may be null). `branches`: repo_url, branch (the known heads). Without
    a given branch the longest known one that starts the rest of the URL is taken. Every folder
    prefix of the rest is looked up by equality, so that the number of branches does not matter.
    """
    target = F.col("target")
    repo, rest = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for mark in TREE_MARKS:
        repo = repo.when(target.contains(mark), text_before(target, mark))
        rest = rest.when(target.contains(mark), F.btrim(text_after(target, mark), F.lit("/")))
    has_mark = F.lit(False)
    for mark in TREE_MARKS:
        has_mark = has_mark | target.contains(mark)
    rows = targets.select("target", "branch").distinct().select(
        "target",
        F.col("branch").alias("given"),
        F.when(~has_mark, target)
        .when(repo.endswith(".git"), repo)
        .otherwise(F.concat(repo, F.lit(".git")))
        .alias("repo_url"),
        rest.alias("rest"),
    )
    parts = F.split("rest", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    known = branches.select("repo_url", F.col("branch").alias("head")).distinct()
    found = (
        rows.filter(F.col("given").isNull() & F.col("rest").isNotNull())
        .select("target", "repo_url", F.explode(prefixes).alias("head"))
        .join(known, ["repo_url", "head"], "left_semi")
        .groupBy("target")
        .agg(F.max_by("head", F.length("head")).alias("matched"))
    )
    below = lambda b: F.when(
        F.startswith("rest", F.concat(b, F.lit("/"))),
        F.btrim(F.substr("rest", F.length(b) + 1), F.lit("/")),
    )
    given = F.col("given")
    joined = rows.join(found, "target", "left")
    branch = F.coalesce("given", "matched", "rest")
    subpath = (
        F.when(F.col("rest").isNull() | (F.col("rest") == branch), None)
        .when(given.isNotNull(), F.coalesce(below(given), F.col("rest")))
        .otherwise(below(F.col("matched")))
    )
    return joined.select("target", F.col("given"), "repo_url", branch.alias("branch"), subpath.alias("subpath"))


def public_urls(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add `public`: https, a host that is not this machine, and only public addresses.

    `resolved` (host, ip) holds the answers of name resolution; a host without any is not public.
    """
    verdict = resolved.groupBy(F.lower("host").alias("_host")).agg(
        F.bool_and(is_public_address(F.col("ip"))).alias("_ok")
    )
    return (
        urls.withColumn("_host", url_host(F.col("url")))
        .join(verdict, "_host", "left")
        .withColumn("public", is_webhook_url(F.col("url")) & F.coalesce("_ok", F.lit(False)))
        .drop("_host", "_ok")
    )
