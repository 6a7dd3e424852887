"""What several operators share: finding rows, literal tables, source lines."""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order in which detectors report; "first" in deduplication means this order.
DETECTORS = {"cve": 1, "misconfig": 2, "secret": 3, "drift": 4, "sast": 5, "git-history": 6}

MAX_CONFIG_ROWS = 5000


def small_rows(df: DataFrame, limit: int = MAX_CONFIG_ROWS) -> list:
    """Rows of a configuration table (rules, checks, patterns), refused if it is not small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} configuration rows: split the table and run once per part")
    return rows


def literal_table(rows: list[dict], columns: str) -> Column:
    """Rows (columns given as DDL) as one constant array, to look things up without a join."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{columns}>>")


def java_pattern(pattern: str) -> str:
    """A Python pattern for the JVM: ignore case, multi-line, only \\n ends a line, named groups in its spelling."""
    plain = lambda name: "g" + re.sub(r"[^A-Za-z0-9]", lambda m: f"{ord(m.group()):x}", name)
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{plain(m[1])}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{plain(m[1])}>", pattern).replace(r"\Z", r"\z")
    return "(?imd)" + pattern


def refusal(spark: SparkSession, pattern: str | None) -> str | None:
    """Why the JVM, which runs the patterns, does not take a pattern; None if it does."""
    if pattern is None:
        return "no pattern"
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except (Py4JJavaError, IllegalArgumentException) as error:
        return str(error).strip().splitlines()[0]
    return None


def usable_rows(df: DataFrame) -> list:
    """Rows of a configuration table whose pattern the JVM takes; a pattern that it refuses never matches."""
    return [r for r in small_rows(df) if refusal(df.sparkSession, r["pattern"]) is None]


def refused_patterns(df: DataFrame) -> DataFrame:
    """Rows of a table of rules, checks or secret patterns that are left out: name, pattern, reason."""
    spark = df.sparkSession
    rows = [(r["name"], r["pattern"], why) for r in small_rows(df) if (why := refusal(spark, r["pattern"]))]
    return spark.createDataFrame(rows, "name string, pattern string, reason string")


def empty_text_if_absent(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit("")


def finding(default_detector: str, **values: Column) -> list[Column]:
    """The columns of a raw finding; whatever is not given is empty."""
    defaults = {
        "description": F.lit(""),
        "line_number": F.lit(0),
        "remediation": F.lit(""),
        "references": F.array().cast("array<string>"),
        "tags": F.array().cast("array<string>"),
        "cvss_score": F.lit(None).cast("double"),
        "is_transitive": F.lit(None).cast("boolean"),
        "context_keyword": F.lit(False),
        "metadata": F.create_map().cast("map<string,string>"),
        "detector": F.lit(DETECTORS[default_detector]),
        "position": F.lit(0).cast("bigint"),
    }
    order = [
        "scan_id", "rule_id", "title", "description", "severity", "category", "file_path", "line_number",
        "evidence", "remediation", "references", "tags", "cvss_score", "is_transitive", "context_keyword",
        "metadata", "detector", "position",
    ]
    return [{**defaults, **values}[name].alias(name) for name in order]


# Words of 64 bits in the filter of `likely_among`.
FILTER_WORDS = 1 << 16


def likely_among(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key may be one of `keys`: all that are, and few others while there are fewer keys than bits.

    One bit stands for the hash of a key. The bits are at most FILTER_WORDS rows however many keys there are, so every
    task gets them, and rows that are not wanted do not reach the shuffle of the join that follows.
    """
    hashed = F.xxhash64(*columns)
    word = lambda h: F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.select(hashed.alias("_h")).groupBy(word(F.col("_h")).alias("_word")).agg(F.bit_or(bit(F.col("_h"))).alias("_bits"))
    marked = rows.withColumn("_h", hashed).join(F.broadcast(bits), word(F.col("_h")) == F.col("_word"))
    return marked.filter(F.col("_bits").bitwiseAND(bit(F.col("_h"))) != 0).select(*rows.columns)


# A key with more than this part of all rows, and more rows than that, is not left to one task.
CROWDED_PART, CROWDED_ROWS = 64, 100_000


def crowded_keys(rows: DataFrame, key: str) -> tuple[list, bool]:
    """Keys that hold a great part of all rows (fewer than CROWDED_PART), and whether there are rows without a key.

    One pass over the keys with a sketch of bounded size, without a shuffle of rows. The sketch errs by less than a
    thousandth of all rows: that may change how rows are dealt, not what is made of them.
    """
    top = F.expr(f"approx_top_k(`{key}`, {CROWDED_PART}, 10000)").alias("top")
    one = rows.agg(F.count(key).alias("n"), F.count_if(F.col(key).isNull()).alias("none"), top).first()
    least = max(CROWDED_ROWS, one["n"] // CROWDED_PART)
    return [x["item"] for x in one["top"] or [] if x["item"] is not None and x["count"] > least], one["none"] > 0


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows that have a key, dealt by it in one shuffle: groups, windows and joins by the key move nothing more.

    `stack` makes the other columns anew, so that no filter and no choice of columns is pushed below the shuffle. It is
    the same then for all that reads these rows, and Spark runs it once. Give only columns that are needed. A crowded
    key is one task's work here: see `crowded_keys`.
    """
    others = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).repartition(key).select(key, F.stack(F.lit(1), *others).alias(*others))


def source_lines(files: DataFrame, wanted: DataFrame, radius: int) -> DataFrame:
    """Lines around wanted places: scan_id, path, line_number, n_lines, lines[num, content].

    `wanted` has scan_id, path, line_number. Every file is joined once, however many places are
    wanted in it; the places of a file are at most its lines, as they are distinct.
    """
    places = wanted.select("scan_id", "path", "line_number").distinct()
    per_file = places.groupBy("scan_id", "path").agg(F.collect_list("line_number").alias("_wanted"))
    # whole texts meet the places and are split behind the join: unwanted files are never split, and few are moved
    split_files = (
        likely_among(files.select("scan_id", "path", "content"), per_file, ["scan_id", "path"])
        .join(per_file, ["scan_id", "path"])
        .select("scan_id", "path", "_wanted", F.split("content", "\r\n|\n|\r").alias("_raw"))
    )
    # a trailing line end does not start another line
    tidy = F.when(
        F.element_at("_raw", -1) == "", F.slice("_raw", 1, F.size("_raw") - 1)
    ).otherwise(F.col("_raw"))
    tidied = split_files.select("scan_id", "path", "_wanted", tidy.alias("_lines"))
    around = F.transform(
        "_wanted",
        lambda n: F.struct(
            n.alias("line_number"),
            F.size("_lines").alias("n_lines"),
            F.when(
                (n - radius <= F.size("_lines")) & (n + radius >= 1),
                F.transform(
                    F.slice(
                        "_lines",
                        F.greatest(n - radius, F.lit(1)),
                        F.greatest(n + radius - F.greatest(n - radius, F.lit(1)) + 1, F.lit(0)),
                    ),
                    lambda text, i: F.struct(
                        (F.greatest(n - radius, F.lit(1)) + i).alias("num"), text.alias("content")
                    ),
                ),
            )
            .otherwise(F.array().cast("array<struct<num:int,content:string>>"))
            .alias("lines"),
        ),
    )
    return tidied.select("scan_id", "path", F.inline(around))
