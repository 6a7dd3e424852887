"""Text dumps of `git log -p`, read commit by commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit: repo, commit_order, record (the text after `COMMIT:`).

    The record separator is the header mark, so that a dump of any length is split among tasks and
    no dump has to fit into one row. `commit_order` sorts the commits of a dump: start of the
    file block, then the row within it. Dumps are named `<repo>.log`.
    """
    raw = spark.read.option("lineSep", "\nCOMMIT:").text(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    return raw.select(
        name.alias("repo"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("commit_order"),
        F.regexp_replace("value", "^COMMIT:", "").alias("record"),
    ).filter(F.size(F.split(F.substring_index("record", "\n", 1), r"\|")) >= 5)


def read_git_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the dumps: repo, part (the file), block (start of the split), line; in the order of the log
    within a split.

    No commit and no file of a commit has to fit into a row: `operators.log_walk` carries headers from line to line and
    from split to split. A dump is `<repo>.log`, or a folder `repo=<repo>` whose files in order are the dump.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, "/repo=([^/]+)/[^/]*$", 1)
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # names in a path are encoded, and those of folders once more by the writer
    return raw.select(
        F.when(folder == "", plain(name)).otherwise(plain(plain(folder))).alias("repo"),
        file.alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def write_git_dumps(records: DataFrame, path: str, *order: str) -> None:
    """Commit records (repo, record, and `order` within a repo) as dumps, in folders `repo=<repo>`. The rows are sorted
    by range, so the parts of one dump can come from many tasks."""
    lines = records.filter("repo is not null and record is not null").repartitionByRange("repo", *order).sortWithinPartitions("repo", *order)
    lines.select("repo", F.concat(F.lit("COMMIT:"), "record")).write.partitionBy("repo").text(path)


def latest_commits(commits: DataFrame, limit: int) -> DataFrame:
    """The first `limit` commits of each repository in log order (the log starts with the newest).

    Only the keys are ranked; the texts of the commits that stay are joined.
    """
    in_log_order = W.partitionBy("repo").orderBy("commit_order")
    ranked = commits.select("repo", "commit_order").withColumn("_n", F.row_number().over(in_log_order))
    return commits.join(ranked.filter(F.col("_n") <= limit), ["repo", "commit_order"], "left_semi").select(*commits.columns)
