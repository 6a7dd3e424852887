"""Secrets in commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import git_secret_id, mask_secret
from palisade.functions.base import any_of
from palisade.operators.common import finding, usable_rows
from palisade.operators.detect import pattern_hits

# Files of the history that are not searched.
SKIPPED_SUFFIXES = [".png", ".jpg", ".gif", ".zip", ".exe", ".bin", ".lock", ".db"]
SKIPPED_PARTS = ["vulnerable", "test-target", ".scan_cache", "test_api", "dummy_"]
REMOVAL_GUIDE = (
    "https://docs.github.com/en/authentication/keeping-your-account-and-data-secure/"
    "removing-sensitive-data-from-a-repository"
)


def git_log_lines(commits: DataFrame) -> DataFrame:
    """Added lines of commit records (see `sources.gitlog`), numbered as in the new file.

    A record is cut into files, a file into hunks, a hunk into lines. Removed lines do not count,
    so within a hunk the number is its start plus the place among the other lines: no window, no
    shuffle.
    """
    head = F.split(F.substring_index("record", "\n", 1), r"\|", 5)
    meta = ["repo", "commit_order", "hash", "short_hash", "author", "date", "message"]
    diff_start = r"(?:^|\n)diff --git(?=[^\n]* b/)"
    # cut at hunk headers that carry a start line
    hunk_start = r"\n@@(?=[^\n]*\+[0-9])"
    body = F.regexp_replace("record", r"^[^\n]*\n?", "")
    files = (
        commits.select(
            "repo",
            "commit_order",
            *[F.get(head, F.lit(i)).alias(n) for i, n in enumerate(meta[2:])],
            F.split(body, diff_start).alias("_files"),
        )
        .select(*meta, F.posexplode("_files").alias("_file_no", "_file"))
        .filter("_file_no > 0")
        .withColumn("path", F.regexp_extract(F.substring_index("_file", "\n", 1), r" b/(.+)$", 1))
    )
    hunks = files.select(
        *meta, "_file_no", "path", F.posexplode(F.split("_file", hunk_start)).alias("_hunk_no", "_hunk")
    )
    start = F.when(
        F.col("_hunk_no") > 0,
        F.regexp_extract(F.substring_index("_hunk", "\n", 1), r"\+([0-9]+)", 1).try_cast("int") - 1,
    ).otherwise(0)
    counted = F.filter(
        F.split(F.regexp_replace("_hunk", r"^[^\n]*\n?", ""), "\n"),
        lambda s: ~(s.startswith("-") | s.startswith("@@") | s.startswith("diff --git")),
    )
    return (
        hunks.select(*meta, "_file_no", "path", start.alias("_start"), F.posexplode(counted).alias("_i", "_line"))
        .filter(F.col("_line").startswith("+") & ~F.col("_line").startswith("+++"))
        .select(
            *meta,
            F.col("_file_no").alias("file_no"),
            "path",
            (F.col("_start") + F.col("_i") + 1).alias("line_number"),
            F.substr("_line", F.lit(2)).alias("line"),
        )
    )


def searched_path(path):
    """Paths of the history that are searched."""
    lower = F.lower(path)
    return ~any_of([path.endswith(s) for s in SKIPPED_SUFFIXES]) & ~any_of(
        [lower.contains(p) for p in SKIPPED_PARTS]
    )


def history_scan(added: DataFrame, patterns: DataFrame) -> DataFrame:
    """Findings over added lines; a secret is reported for the first commit in log order only.

    One row per (repo, pattern, path, masked value). Each map task keeps one candidate per key
    before the shuffle, so a secret copied everywhere does not fill one reducer.
    """
    lines = added.filter(searched_path(F.col("path")))
    hits = pattern_hits(lines, usable_rows(patterns)).withColumn("masked", mask_secret(F.col("matched")))
    order = [F.col(c) for c in ("commit_order", "file_no", "line_number") if c in added.columns]
    first = W.partitionBy("repo", "pattern.name", "path", "masked").orderBy(*order)
    rows = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    name, short = F.col("pattern.name"), F.col("short_hash")
    return rows.select(
        finding(
            "git-history",
            scan_id=F.col("repo"),
            rule_id=git_secret_id(name, short, F.col("path")),
            title=F.concat(F.lit("Git History: "), name),
            description=F.concat(
                F.col("pattern.description"),
                F.lit(" This secret was found in commit "), short,
                F.lit(" by "), F.col("author"), F.lit(" on "), F.col("date"), F.lit("."),
            ),
            severity=F.col("pattern.severity"),
            category=F.lit("secret"),
            file_path=F.col("path"),
            line_number=F.col("line_number"),
            evidence=F.concat(
                F.lit("Commit: "), short, F.lit(" | Author: "), F.col("author"),
                F.lit(" | Date: "), F.col("date"), F.lit(" | Secret: "), F.col("masked"),
            ),
            remediation=F.concat(
                F.lit("This secret was exposed in commit "), F.col("hash"),
                F.lit(
                    ". 1) Rotate the credential immediately. 2) Use git filter-branch or BFG Repo Cleaner"
                    " to purge it from history. 3) Force-push the cleaned history."
                ),
            ),
            references=F.array(F.lit(REMOVAL_GUIDE)),
            tags=F.concat(F.array(F.lit("git-history"), F.lit("leaked-credential")), F.col("pattern.tags")),
            metadata=F.create_map(
                F.lit("commit_hash"), F.col("hash"), F.lit("commit_short"), short,
                F.lit("commit_author"), F.col("author"), F.lit("commit_date"), F.col("date"),
                F.lit("commit_message"), F.col("message"),
                F.lit("pattern_name"), name, F.lit("masked_value"), F.col("masked"),
            ),
            position=F.col("pattern_no").cast("bigint"),
        )
    )
