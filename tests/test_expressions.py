"""Literal cases of scalar expressions."""

import math

import pytest
from pyspark.sql import functions as F

from palisade import functions as P
from palisade.functions.paths import glob_regex
from palisade.operators import scoring


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "word, level",
    [
        ("CRITICAL", "critical"), ("crit", "critical"), ("high", "high"), ("h", "high"), ("moderate", "medium"),
        ("medium", "medium"), ("low", "low"), ("l", "low"), ("info", "info"), ("unknown_severity", "info"),
        (None, "info"), ("\tHigh \n", "high"),
    ],
)
def test_normalize_severity(spark, word, level):
    assert one(spark, P.normalize_severity(F.lit(word).cast("string"))) == level


@pytest.mark.parametrize(
    "kev, epss, cvss, expected",
    [
        (True, 0.0, 0.0, "immediate"), (False, 0.70, 0.0, "immediate"), (False, 0.30, 0.0, "high"),
        (False, 0.0, 8.0, "high"), (False, 0.05, 0.0, "scheduled"), (False, None, 5.0, "scheduled"),
        (False, None, None, "monitor"),
    ],
)
def test_priority(spark, kev, epss, cvss, expected):
    got = one(spark, P.priority(F.lit(kev), F.lit(epss).cast("double"), F.lit(cvss).cast("double")))
    assert got == expected


def finding(path, evidence="", severity="medium", category="misconfig", title="t", **more):
    return {"file_path": path, "evidence": evidence, "severity": severity, "category": category, "title": title,
            "description": "", "cvss_score": 0.0, "finding_id": path, **more}


SCHEMA = ("file_path string, evidence string, severity string, category string, title string, description string, "
          "cvss_score double, finding_id string, is_transitive boolean, tags array<string>")


def scored(spark, *rows, banking=True):
    return scoring.score(spark.createDataFrame(list(rows), SCHEMA), banking).collect()


def test_scores(spark):
    plain, pay, auth = scored(
        spark, finding("src/utils/helpers.py"), finding("src/payments/processor.py"), finding("src/auth/login.py")
    )
    assert (plain.final_score, plain.severity) == (5.0, "medium")
    assert (pay.final_score, pay.severity) == (8.5, "high")
    assert [m.name for m in pay.modifiers] == ["critical_banking_module", "banking_context"]
    assert (auth.final_score, auth.severity) == (7.0, "high")
    tests = scored(spark, finding("/tests/utils/test_helpers.py"), banking=False)[0]
    assert (tests.final_score, tests.severity) == (4.0, "medium")
    assert [(m.name, m.delta) for m in tests.modifiers] == [("test_directory", -1.0)]


def test_transitive_null_is_not_direct(spark):
    rows = scored(
        spark,
        *[finding("a.txt", category="cve", is_transitive=v, severity="low") for v in (True, False, None)],
    )
    assert [r.final_score for r in rows] == [2.5, 3.5, 2.5]


def test_words_within_words_and_tags_count(spark):
    expand, remind, tagged, none = scored(
        spark, finding("a", "expand"), finding("a", "reMInd"), finding("a", "x", tags=["PCI-DSS"]), finding("a", "x")
    )
    assert [r.final_score for r in (expand, remind, tagged, none)] == [6.5, 6.5, 6.5, 5.0]


def test_malformed_rows_fall_back(spark):
    rows = scored(spark, finding(None, severity="high"), finding("a", None, severity="odd"), finding("a", severity=None))
    assert [(r.final_score, r.severity, r.modifiers) for r in rows] == [
        (5.0, "high", []), (5.0, "medium", []), (5.0, "medium", [])
    ]


def test_score_stays_in_range(spark):
    top = finding("/payments/prod/x", "payment", cvss_score=9.9, category="secret")
    assert scored(spark, top)[0].final_score == 10.0
    low = finding("/tests/examples/x", severity="info", category="misconfig")
    assert scored(spark, low, banking=False)[0].final_score == 0.0


@pytest.mark.parametrize("text", ["aabb", "abcd", "", "x", "a1b2c3d4e5é✓", "ab ab"])
def test_entropy(spark, text):
    shares = [text.count(ch) / len(text) for ch in set(text)]
    expected = -sum(p * math.log2(p) for p in shares)
    assert one(spark, P.shannon_entropy(F.lit(text))) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(
    "url, masked",
    [
        ("https://hooks.example.com/services/T123/B45678/abcdef", "https://hooks.example.com/services/****/B45...****/abc...****"),
        ("https://example.com/x/y", "https://exam...********"), ("short", "*****"), ("", ""),
    ],
)
def test_mask_webhook(spark, url, masked):
    assert one(spark, P.mask_webhook(F.lit(url))) == masked


def test_mask_db_url(spark):
    got = [one(spark, P.mask_db_url(F.lit(u))) for u in ("pg://u:p@h/x", "pg://u:p@ss@h", "sqlite:///a", "pg://u@h")]
    assert got == ["pg://u:********@h/x", "pg://u:********@h", "sqlite:///a", "pg://u@h"]


def test_masks_and_ids(spark):
    assert one(spark, P.mask_secret(F.lit("12345678"))) == "********"
    assert one(spark, P.mask_secret(F.lit("AKIA123456"))) == "AKIA**3456"
    got = one(spark, P.git_secret_id(F.lit("AWS Key (v2)"), F.lit("abc1234"), F.lit("a/b.py")))
    assert got.startswith("GIT-SECRET-AWS-KEY--V2-abc1234-") and len(got.rsplit("-", 1)[1]) == 6


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("*.py", "/a/b/c.py", True), ("*.py", "/a/c.PY", False), ("**/config/*.yml", "/x/config/y/z.yml", True),
        ("Dockerfile.*", "/d/Dockerfile.dev", True), ("a?c", "/x/abc", True), ("[!a]*.txt", "/q/b.txt", True),
        ("[!a]*.txt", "a.txt", False), ("x[", "x[", True), ("a.b", "/axb", False),
    ],
)
def test_glob(spark, glob, path, hit):
    assert one(spark, P.glob_match(F.lit(path), [glob])) is hit


def test_glob_regex_escapes():
    assert glob_regex("a+b") == "a\\+b"


@pytest.mark.parametrize(
    "path, config", [("/a/.env", False), ("/a/prod.env", True), ("/a/Dockerfile", True), ("x.YML", True), ("a.py", False)]
)
def test_config_file(spark, path, config):
    assert one(spark, P.is_config_file(F.lit(path))) is config


@pytest.mark.parametrize(
    "path, root, clean",
    [("/r/a/b", "/r", "a/b"), ("/r2/a", "/r", "2/a"), ("/q/a", "/r", "/q/a"), ("", "/r", ""), ("/r", "/r", "."), ("a/b", "/r", "a/b")],
)
def test_clean_path(spark, path, root, clean):
    assert one(spark, P.clean_path(F.lit(path), F.lit(root))) == clean


@pytest.mark.parametrize(
    "ip, public",
    [
        ("8.8.8.8", True), ("10.1.2.3", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.0.1", False),
        ("127.0.0.1", False), ("169.254.1.1", False), ("224.0.0.1", False), ("0.0.0.0", False), ("999.1.1.1", False),
        ("::1", False), ("fe80::1", False), ("fd00::1", False), ("2606:4700::1111", True), ("junk", False),
    ],
)
def test_public_address(spark, ip, public):
    assert one(spark, P.is_public_address(F.lit(ip))) is public


def test_version_order(spark):
    def less(a, b):
        return one(spark, P.version_key(F.lit(a)) < P.version_key(F.lit(b)))

    assert less("1.9", "1.10") and less("1.0", "1.0.1") and not less("1.0.0", "1.0") and not less("1.0", "1.0.0")
    assert less("1.0.20240101000000", "1.0.20240101000001") and less("1.9.0-beta.1", "1.9.0") and less("1.8.9", "1.9.0-beta.1")
    assert less("1.0.dev1", "1.0a1") and less("1.0a2", "1.0b1") and less("1.0b1", "1.0rc1") and less("1.0rc1", "1.0") and less("1.0", "1.0.post1")
    assert less("1.0-alpha", "1.0-alpha.1") and less("1.0-beta.2", "1.0-beta.11") and less("1.0-SNAPSHOT", "1.0") and not less("1.0.Final", "1.0")
    assert one(spark, P.version_key(F.lit("weird"))) is None


def test_git_evidence_last_key_wins(spark):
    got = one(spark, P.parse_git_evidence(F.lit("Commit: a | x | Author: b:c | commit: d")))
    assert got == {"author": "b:c", "commit": "d"}


def test_vector_estimate(spark):
    vector = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    assert one(spark, P.cvss_vector_estimate(F.lit(vector))) == 9.5
    assert one(spark, P.cvss_vector_estimate(F.lit(""))) == 0.0


def test_impact_by_rule_family(spark):
    def impact(rule, title="", category="misconfig"):
        return one(spark, P.impact(F.lit(category), F.lit(rule), F.lit(title), F.lit(None).cast("string")))

    assert impact("INFRA-001") == impact("ACME-INFRA-001") != impact("INFRA-0011")
    assert impact("ACME-DB-002") == impact("x", "SQL mode")
    assert impact("x", category="cve").startswith("Using a third-party library with")
