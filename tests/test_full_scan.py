"""A scan of a folder over all detectors, by scan type, and what it refuses."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.plans import full_scan
from palisade.plans.full_scan import SCAN_TYPES, ScanInputs, run_scan
from palisade.schemas import ADVISORY, CHECK, RULE, SECRET_PATTERN
from palisade.session import cut_lineage
from palisade.sources import corpus, gitlog, rules

TOKEN = 'token = "' + "0f" * 20 + '"\n'
OSV = {"id": "OSV-1", "aliases": ["CVE-2024-1"], "affected": [{"package": {"ecosystem": "PyPI", "name": "flask"}, "versions": ["1.0"]}]}
REPORT = json.dumps({"results": [{"check_id": "C1", "path": "a.py", "start": {"line": 3}, "extra": {"message": "m", "severity": "ERROR"}}]})
LOG = "COMMIT:h|s|ann|2025|m\ndiff --git a/x b/x.py\n@@ -0,0 +5 @@\n+" + TOKEN + "COMMIT:broken\n"
OF = {"dependencies": "cve", "misconfig": "misconfig", "secrets": "secret", "drift": "drift", "sast": "sast", "git-history": "git-history"}
NUMBER = {"cve": 1, "misconfig": 2, "secret": 3, "drift": 4, "sast": 5, "git-history": 6}


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    logs = tmp_path_factory.mktemp("logs")
    for scan in [*SCAN_TYPES, "odd"]:
        for name, text in {
            "app/Dockerfile": "FROM base:latest\n", "app/settings.yml": "debug = true\n" + TOKEN, "app/requirements.txt": "flask==1.0\n-r more/base.txt\n",
            "app/more/base.txt": "six==1\n", "node_modules/x/requirements.txt": "flask==1.0\n", "app/package.json": "{", "app/pom.xml": "<project",
        }.items():
            (root / scan / name).parent.mkdir(parents=True, exist_ok=True)
            (root / scan / name).write_text(text)
        (logs / f"{scan}.log").write_text(LOG)
    types = [(t, t) for t in SCAN_TYPES] + [("odd", "everything"), ("none", None)]
    files = corpus.read_corpus(spark, str(root))
    no_text = files.limit(0).union(spark.createDataFrame([("full", "/x", "x", None, 0)], files.schema))
    patterns = rules.builtin_secret_patterns(spark).unionByName(spark.createDataFrame([("bad", "(", "high", "", [])], SECRET_PATTERN))
    checks = rules.builtin_baselines(spark).unionByName(spark.createDataFrame([("nginx", "X", "bad check", "", "low", "must_exist", "(", "", [])], CHECK))
    return run_scan(
        ScanInputs(
            scans=spark.createDataFrame(types, "scan_id string, scan_type string"),
            files=files.unionByName(no_text),
            rules=rules.builtin_rules(spark),
            patterns=patterns,
            checks=checks,
            advisories=spark.createDataFrame([json.dumps(OSV), json.dumps({"summary": "no id"})], "string").select(F.from_json("value", ADVISORY).alias("d")).select("d.*"),
            reports=spark.createDataFrame([(t, *r) for t in [*SCAN_TYPES, "odd"] for r in [("semgrep", REPORT), ("bandit", "{"), ("semgrep", None), ("bandit", "[]"), ("lint", "{}"), (None, "{}")]], "scan_id string, tool string, document string"),
            git_lines=gitlog.read_git_lines(spark, str(logs)),
        )
    )


def test_detectors_by_scan_type(result):
    got = {(r.scan_id, r.detector) for r in result.raw.select("scan_id", "detector").distinct().collect()}
    want = {(t, NUMBER[d]) for t, d in OF.items()} | {("full", n) for n in NUMBER.values()}
    assert got == want


def test_packages_and_manifests(result):
    found = {(r.scan_id, r["name"]) for r in result.dependencies.collect()}
    assert found == {(t, n) for t in ("full", "dependencies") for n in ("flask", "six")}
    assert {r.path.split("corpus0/")[-1] for r in result.manifests.filter("scan_id = 'full'").collect()} == {"full/app/requirements.txt", "full/app/package.json", "full/app/pom.xml"}
    cve = result.raw.filter("detector = 1").collect()
    assert {(r.scan_id, r.rule_id) for r in cve} == {("full", "CVE-2024-1"), ("dependencies", "CVE-2024-1")} and len(cve) == 2


def test_refused(result):
    rows = [(r.scan_id, r.detector, r.reason) for r in result.refused.collect()]
    assert {(s, d, r) for s, d, r in rows if d in ("scan", "files", "git-history")} == {
        ("odd", "scan", "unknown scan type"), ("none", "scan", "unknown scan type"), ("full", "files", "no text"),
        ("full", "git-history", "broken header"), ("git-history", "git-history", "broken header"),
    }
    assert sorted((d, r) for s, d, r in rows if s == "full" and d in ("cve", "sast")) == [
        ("cve", "no JSON"), ("cve", "no XML"), ("sast", "no JSON"), ("sast", "no JSON"), ("sast", "no results"), ("sast", "unknown tool"), ("sast", "unknown tool"),
    ]
    assert {d for s, d, _ in rows if s is None} == {"cve", "secret", "drift"}
    assert not any(s in ("secrets", "misconfig") for s, d, _ in rows if d != "scan")


def test_stored(result):
    stored = result.stored()
    assert stored.count() == stored.select("finding_id").distinct().count() > 10
    assert {r.category for r in stored.filter("scan_id = 'full'").collect()} >= {"cve", "misconfig", "secret", "drift", "sast"}


def test_parts_may_be_missing(spark):
    scans = spark.createDataFrame([("s", "full")], "scan_id string, scan_type string")
    files = spark.createDataFrame([("s", "/a.yml", TOKEN)], "scan_id string, path string, content string")
    only = run_scan(ScanInputs(scans=scans, files=files, patterns=rules.builtin_secret_patterns(spark)))
    assert [r.detector for r in only.raw.collect()] == [3] and only.dependencies.count() == 0
    with pytest.raises(ValueError, match="nothing to scan"):
        run_scan(ScanInputs(scans=scans))


def test_patterns_run_once_per_text(spark, monkeypatch):
    """No filter below the first write holds the patterns, which would have them run twice."""
    written = []
    monkeypatch.setattr(full_scan, "cut_lineage", lambda df: (written.append(df), cut_lineage(df))[1])
    rule = [("R1", "n", "", "high", "c", "zz_pattern_of_the_test", ["*"], "", [], [])]
    files = spark.createDataFrame([("s", "/a.yml", "zz_pattern_of_the_test"), ("s", "/b.yml", "no"), ("s", "/c.yml", None), ("s", "/requirements.txt", "a==1")], "scan_id string, path string, content string")
    scans = spark.createDataFrame([("s", "full")], "scan_id string, scan_type string")
    result = full_scan.run_scan(full_scan.ScanInputs(scans, files, spark.createDataFrame(rule, RULE)))
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "zz_pattern" in line]
    assert [(r.file_path, r.rule_id) for r in result.raw.collect()] == [("/a.yml", "R1")]
    assert [(r.path, r.name) for r in result.dependencies.collect()] == [("/requirements.txt", "a")]
    assert [(r.place, r.reason) for r in result.refused.collect()] == [("/c.yml", "no text")]
