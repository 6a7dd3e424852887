"""Directives of container files and web-server configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.base import strip


def dockerfile_directives(files: DataFrame) -> DataFrame:
    """scan_id, path, instruction, arguments, line: continued lines joined, `line` is the last of them."""
    kept = F.filter(
        F.transform(
            F.split("content", "\n"), lambda text, i: F.struct(strip(text).alias("s"), (i + 1).alias("n"))
        ),
        lambda x: (x["s"] != "") & ~x["s"].startswith("#"),
    )
    continued = lambda x: x["s"].endswith("\\")
    # index of the last line of every directive
    ends = F.filter(
        F.transform("_kept", lambda x, i: F.when(~continued(x), i)), lambda i: i.isNotNull()
    )
    first = lambda j: F.coalesce(F.get("_ends", j - 1) + 1, F.lit(0))
    piece = lambda x: F.when(
        continued(x), F.concat(strip(F.left(x["s"], F.length(x["s"]) - 1)), F.lit(" "))
    ).otherwise(x["s"])
    whole = F.transform(
        "_ends",
        lambda e, j: F.struct(
            F.ltrim(
                F.array_join(F.transform(F.slice("_kept", first(j) + 1, e - first(j) + 1), piece), "")
            ).alias("text"),
            F.get("_kept", e)["n"].alias("line"),
        ),
    )
    return (
        files.select("scan_id", "path", kept.alias("_kept"))
        .select("scan_id", "path", "_kept", ends.alias("_ends"))
        .select("scan_id", "path", F.inline(whole))
        .select(
            "scan_id",
            "path",
            F.upper(F.regexp_extract("text", r"^(\S+)", 1)).alias("instruction"),
            F.regexp_replace("text", r"^\S+\s*", "").alias("arguments"),
            "line",
        )
    )


def nginx_directives(files: DataFrame) -> DataFrame:
    """scan_id, path, directive, value, line, block (path of the open blocks).

    A line with a brace opens or closes a block; a fold over these lines gives the path after each of them. A
    directive takes the path after the last brace above it. Rows stay where they are.
    """
    said = F.filter(
        F.transform(F.split("content", "\n"), lambda x, i: F.struct(strip(x).alias("text"), (i + 1).alias("line"))),
        lambda x: ~x["text"].rlike("^(#|$)"),
    )
    strings = F.array().cast("array<string>")

    def step(state: Column, brace: Column) -> Column:
        name = strip(F.replace(brace["text"], F.lit("{"), F.lit("")))
        up = F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        now = F.when(F.contains(brace["text"], F.lit("{")), F.concat(state["open"], F.array(name))).otherwise(up)
        return F.struct(now.alias("open"), F.concat(state["paths"], F.array(F.array_join(now, "/"))).alias("paths"))

    paths = F.aggregate("_braces", F.struct(strings.alias("open"), strings.alias("paths")), step, lambda x: x["paths"])
    is_brace = lambda x: x["text"].rlike("[{}]")
    parts = (
        files.select("scan_id", "path", said.alias("_said"))
        .withColumn("_braces", F.filter("_said", is_brace))
        .withColumn("_paths", paths)
        .withColumn("_at", F.transform("_braces", lambda x: x["line"]))
        .select("scan_id", "path", "_paths", "_at", F.inline(F.filter("_said", lambda x: ~is_brace(x) & F.contains(x["text"], F.lit(";")))))
    )
    above = F.size(F.filter("_at", lambda n: n < F.col("line")))
    text = strip(F.regexp_replace("text", ";+$", ""))
    return parts.withColumn("_t", text).filter("_t <> ''").select(
        "scan_id",
        "path",
        F.regexp_extract("_t", r"^(\S+)", 1).alias("directive"),
        strip(F.regexp_replace("_t", r"^\S+", "")).alias("value"),
        "line",
        F.coalesce(F.get("_paths", above - 1), F.lit("")).alias("block"),
    )
