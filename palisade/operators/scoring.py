"""Contextual scores of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.base import any_of, pick
from palisade.functions.severity import BASE_SCORE, score_to_severity
from palisade.schemas import SEVERITIES

# Words of the banking context.
BANKING_WORDS = [
    "payment", "transaction", "account", "banking", "upi", "neft", "rtgs", "imps", "kyc", "aadhar",
    "pan", "aadhaar", "ifsc", "swift", "iban", "credit", "debit", "wallet", "fintech", "ledger",
    "settlement", "merchant", "pci", "pci-dss", "cardholder", "cvv", "card_number", "routing_number",
    "wire_transfer", "escrow", "forex", "mutual_fund", "insurance", "loan", "emi",
]
# Parts of paths that belong to production, in any case.
PRODUCTION_PARTS = [
    "prod", "production", "live", "release", "deploy", ".env.prod", "application-prod", "docker-compose.prod",
]
# Folder patterns.
TEST_DIRS = r"(?i)[\\/](?:test|tests|__tests__|spec|specs|testing|test_|_test)[\\/]"
EXAMPLE_DIRS = r"(?i)[\\/](?:example|examples|sample|samples|demo|demos|fixtures|mock|mocks)[\\/]"
BANKING_DIRS = (
    r"(?i)[\\/](?:payment|payments|checkout|billing|card|auth|authorization|authentication|login"
    r"|transaction|transactions|ledger|transfer|transfers|wallet|wallets)(?:[\\/]|$)"
)


def holds_any(text: Column, words: list[str]) -> Column:
    """True if a word occurs anywhere in the text.

    Plain substring tests, several times faster than one pattern of all words. Words that contain
    another word of the list need no test of their own.
    """
    shortest = [w for w in words if not any(other != w and other in w for other in words)]
    return any_of([F.contains(text, F.lit(w)) for w in shortest])


def base_score(cvss: Column, severity: Column) -> Column:
    """The vulnerability score if there is one, else the number of the severity."""
    return F.when(cvss > 0, cvss).otherwise(pick(F.lower(severity), BASE_SCORE, 0.5))


def banking_context(df: DataFrame) -> Column:
    """True if a banking word occurs, also within other words, in path, texts, context or tags."""
    texts = [F.col(c) for c in ("file_path", "evidence", "description", "title", "context") if c in df.columns]
    if "tags" in df.columns:
        texts.append(F.array_join("tags", " "))
    hit = holds_any(F.lower(F.concat_ws(" ", *texts)), BANKING_WORDS)
    if "context_keyword" in df.columns:
        hit = hit | F.coalesce("context_keyword", F.lit(False))
    return hit


def _malformed(df: DataFrame, banking: bool) -> Column:
    """Rows that lack what scoring reads."""
    needed = ["file_path"] + (["evidence", "description", "title"] if banking else [])
    lacking = F.lit(False)
    for name in needed:
        if name in df.columns:
            lacking = lacking | F.col(name).isNull()
    return lacking | (F.col("severity").isNull() & ~F.coalesce(F.col("cvss_score") > 0, F.lit(False)))


def modifiers(df: DataFrame, banking: bool = True) -> list[tuple[str, float, Column]]:
    """Name, amount and condition of every adjustment."""
    path = F.col("file_path")
    in_tests = path.rlike(TEST_DIRS)
    direct = F.lit(False)
    if "is_transitive" in df.columns:
        direct = F.coalesce(~F.col("is_transitive"), F.lit(False)) & (F.col("category") == "cve")
    rows = [
        ("critical_banking_module", 2.0, path.rlike(BANKING_DIRS)),
        ("production_config", 2.0, holds_any(F.lower(path), PRODUCTION_PARTS)),
        ("direct_dependency", 1.0, direct),
        ("secret_non_test", 1.0, (F.col("category") == "secret") & ~in_tests),
    ]
    if banking:
        rows.append(("banking_context", 1.5, banking_context(df)))
    rows += [
        ("test_directory", -1.0, in_tests),
        ("example_directory", -0.5, path.rlike(EXAMPLE_DIRS)),
    ]
    return rows


def score(df: DataFrame, banking: bool = True) -> DataFrame:
    """Add base_score, modifiers, final_score and original_severity; severity becomes the scored one.

    A row that lacks a needed field gets 5.0 and keeps its severity if that is one of the five,
    else medium.
    """
    rows = modifiers(df, banking)
    names = [f"_m{i}" for i in range(len(rows))]
    flagged = df.withColumns(
        {
            "_bad": _malformed(df, banking),
            "_base": base_score(F.col("cvss_score"), F.col("severity")),
            **{n: F.coalesce(cond, F.lit(False)) for n, (_, _, cond) in zip(names, rows)},
        }
    )
    total = F.lit(0.0)
    for n, (_, amount, _) in zip(names, rows):
        total = total + F.when(F.col(n), F.lit(amount)).otherwise(0.0)
    listed = F.array_compact(
        F.array(
            *[
                F.when(F.col(n), F.struct(F.lit(label).alias("name"), F.lit(amount).alias("delta")))
                for n, (label, amount, _) in zip(names, rows)
            ]
        )
    )
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("_base") + total))
    kept = F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise("medium")
    nothing = F.array().cast("array<struct<name:string,delta:double>>")
    return (
        flagged.withColumn("_final", clipped)
        .withColumns(
            {
                "base_score": F.when(F.col("_bad"), 5.0).otherwise(F.col("_base")),
                "modifiers": F.when(F.col("_bad"), nothing).otherwise(listed),
                "final_score": F.when(F.col("_bad"), 5.0).otherwise(F.round("_final", 1)),
                "original_severity": F.col("severity"),
                "severity": F.when(F.col("_bad"), kept).otherwise(score_to_severity(F.col("_final"))),
            }
        )
        .drop("_bad", "_base", "_final", *names)
    )


def score_all(df: DataFrame, banking: bool = True, tie_break: str = "finding_id") -> DataFrame:
    """Scored findings, the highest first."""
    return score(df, banking).orderBy(F.col("final_score").desc(), tie_break)
