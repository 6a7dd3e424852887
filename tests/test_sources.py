"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.operators import history
from palisade.sources import corpus, feeds, gitlog, reports, rules, sinks


def put(folder, name, text):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_corpus_repairs_bytes(spark, tmp_path):
    put(tmp_path, "s1/a.py", b"ok \xff\xfe end")
    put(tmp_path, "s1/build/b.py", "x = 1")
    put(tmp_path, "s2/c.txt", "hé")
    rows = {r.relative_path: r for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"s1/a.py", "s1/build/b.py", "s2/c.txt"}
    assert rows["s1/a.py"].content.startswith("ok �") and rows["s1/a.py"].content.endswith(" end")
    assert rows["s2/c.txt"].scan_id == "s2" and rows["s2/c.txt"].content == "hé" and rows["s2/c.txt"].size_bytes == 3
    kept = corpus.exclude_dirs(corpus.read_corpus(spark, str(tmp_path), scan_id="one"), "manifest")
    assert sorted(r.relative_path for r in kept.collect()) == ["s1/a.py", "s2/c.txt"]
    assert corpus.oversized_files(spark, str(tmp_path), 5).count() == 1
    assert corpus.read_corpus(spark, str(tmp_path), glob="*.py").count() == 2


def test_root_below_skipped_folder_is_read(spark, tmp_path):
    put(tmp_path, "build/s/a.yml", "a: 1")
    files = corpus.read_corpus(spark, str(tmp_path / "build"))
    assert corpus.exclude_dirs(files, "manifest").count() == 1


def test_rule_shapes(spark, tmp_path):
    put(tmp_path, "one.yaml", "id: A\nname: a\npattern: x\nseverity: HIGH\n")
    put(tmp_path, "sub/list.yml", "- {id: B, name: b, pattern: y, file_types: ['*.py']}\n- {id: C, name: c}\n")
    put(tmp_path, "keyed.yaml", "rules:\n - {id: D, name: d, pattern: z, enabled: false}\n - {id: E, name: e, pattern: '('}\n - {id: F, name: f, pattern: q}\n")
    put(tmp_path, "broken.yaml", "a: [1,\n")
    rows = {r.rule_id: r for r in rules.read_rules(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A", "B", "F"}
    assert rows["A"].severity == "high" and rows["F"].severity == "medium" and rows["F"].category == "misconfiguration"
    assert rows["F"].file_types == ["*"] and rows["B"].file_types == ["*.py"]


def test_builtin_rules(spark):
    ids = [r.rule_id for r in rules.builtin_rules(spark).collect()]
    assert len(ids) == 11 and {"BANK-001", "CRYPTO-001", "WEB-003"} <= set(ids)
    prefixed = {r.rule_id for r in rules.builtin_rules(spark, "ACME-").collect()}
    assert {"BANK-001", "ACME-CRYPTO-001"} <= prefixed


def test_baselines(spark, tmp_path):
    counts = {r.config_type: r["count"] for r in rules.builtin_baselines(spark).groupBy("config_type").count().collect()}
    assert counts == {"Dockerfile": 5, "docker-compose": 4, "nginx": 5, "spring": 4}
    put(tmp_path, "mine.yaml", "config_type: nginx\nchecks:\n - {pattern: abc}\n")
    put(tmp_path, "redis.yaml", "checks:\n - {id: R1, pattern: abc, check_type: must_exist}\n")
    rows = rules.read_baselines(spark, str(tmp_path))
    assert rows.count() == 20
    extra = {r.check_id: r for r in rows.collect()}
    assert extra["CUSTOM-mine"].check_type == "must_not_match" and extra["CUSTOM-mine"].severity == "medium"
    assert extra["R1"].config_type == "redis"


def test_secret_patterns_extend(spark, tmp_path):
    put(tmp_path, "p.yaml", "- {name: Mine, pattern: 'k=[0-9]+'}\n")
    names = [r.name for r in rules.read_secret_patterns(spark, str(tmp_path)).collect()]
    assert names[-1] == "Mine" and len(names) == rules.builtin_secret_patterns(spark).count() + 1


def test_feeds(spark, tmp_path):
    put(tmp_path, "kev.json", json.dumps({"vulnerabilities": [
        {"cveID": "cve-2023-0001", "vendorProject": "v", "product": "old"},
        {"cveID": "CVE-2023-0001", "product": "new", "shortDescription": "d"},
        {"cveID": "", "product": "none"}, {"product": "none"},
    ]}))
    put(tmp_path, "epss.json", json.dumps({"data": [
        {"cve": "CVE-2023-0001", "epss": "0.923", "percentile": "0.991"}, {"cve": "CVE-1", "epss": "n/a", "percentile": "0.5"},
    ]}))
    kev = feeds.read_kev(spark, str(tmp_path / "kev.json")).collect()
    assert [(r.cve_id, r.product, r.short_description) for r in kev] == [("CVE-2023-0001", "new", "d")]
    epss = {r.cve_id: (r.epss, r.percentile) for r in feeds.read_epss(spark, str(tmp_path / "epss.json")).collect()}
    assert epss == {"CVE-2023-0001": (0.923, 0.991), "CVE-1": (None, 0.5)}


def test_advisories(spark, tmp_path):
    from palisade.operators import advisories as adv

    docs = [
        {"id": "GHSA-1", "aliases": ["X", "CVE-2020-1"], "severity": [{"type": "CVSS_V3", "score": "AV:N/AC:L/PR:N/UI:N/C:H/I:H/A:H"}],
         "summary": "s", "affected": [{"package": {"ecosystem": "PyPI", "name": "req"},
          "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.5"}, {"introduced": "2.0"}, {"fixed": "2.2"}]}], "versions": ["9.9rc1"]}],
         "references": [{"url": "u1"}, {}]},
        {"id": "GHSA-2", "details": "only details", "affected": []},
    ]
    put(tmp_path, "osv.jsonl", "\n".join(json.dumps(d) for d in docs))
    table = feeds.read_advisories(spark, str(tmp_path / "osv.jsonl"))
    flat = {r.osv_id: r for r in adv.advisory_flatten(table).collect()}
    assert flat["GHSA-1"].cve_id == "CVE-2020-1" and flat["GHSA-1"].cvss_score == 9.5 and flat["GHSA-1"].severity == "critical"
    assert flat["GHSA-1"].fixed_versions == ["1.5", "2.2"] and flat["GHSA-1"].affected_versions == [">=2.0", "9.9rc1"]
    assert flat["GHSA-2"].severity == "medium" and flat["GHSA-2"].cvss_score == 5.5 and flat["GHSA-2"].summary == "only details"
    versions = ["0.9", "1.5", "1.10", "2.1", "2.2", "9.9rc1", "weird"]
    deps = spark.createDataFrame([("s", "p", "req", v, "pypi", None, False, False) for v in versions],
                                 "scan_id string, path string, name string, version string, ecosystem string, group_id string, is_dev boolean, is_transitive boolean")
    hits = {r.version: r.match_kind for r in adv.match_advisories(deps, adv.advisory_ranges(table)).collect()}
    assert hits == {"0.9": "range", "2.1": "range", "9.9rc1": "exact"}
    found = adv.cve_findings(deps, adv.advisory_ranges(table), adv.advisory_flatten(table)).collect()
    assert {f.remediation for f in found} == {f"Upgrade req from {v} to 1.5 (other fixed versions: 2.2)" for v in hits}


LOG = """COMMIT:h1|s1|ann|2024|first | with bar

diff --git a/x b/src/x.py
new file mode 100644
index 000..111
--- /dev/null
+++ b/src/x.py
@@ -0,0 +1,3 @@
+one
+++strange
+token = "{token}"
@@ -10,2 +20,3 @@ def f
 context
-removed
+twenty one
\\ No newline at end of file
diff --git a/logo b/logo.png
+in a picture
COMMIT:broken
+lost
COMMIT:h2|s2|bob|2025|second
diff --git a/y b/y
@@ -0,0 +5 @@
+five
"""


def log_rows(spark, path):
    return history.git_log_lines(gitlog.read_git_log(spark, path)).orderBy("commit_order", "file_no", "line_number").collect()


def test_git_log(spark, tmp_path):
    put(tmp_path, "repo1.log", LOG.replace("{token}", "ab" * 20))
    rows = log_rows(spark, str(tmp_path))
    assert [(r.repo, r.hash, r.path, r.line_number, r.line) for r in rows] == [
        ("repo1", "h1", "src/x.py", 1, "one"),
        ("repo1", "h1", "src/x.py", 3, f'token = "{"ab" * 20}"'),
        ("repo1", "h1", "src/x.py", 21, "twenty one"),
        ("repo1", "h1", "logo.png", 1, "in a picture"),
        ("repo1", "h2", "y", 5, "five"),
    ]
    assert rows[0].message == "first | with bar" and rows[0].author == "ann"


def test_git_log_in_many_splits_keeps_order(spark, tmp_path):
    text = "".join(
        f"COMMIT:h{i}|s{i}|a|d|m\ndiff --git a/f b/f\n@@ -0,0 +1 @@\n+line {i} {'x' * (i % 17)}\n" for i in range(400)
    )
    put(tmp_path, "big.log", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        commits = gitlog.read_git_log(spark, str(tmp_path))
        assert commits.rdd.getNumPartitions() > 5
        rows = history.git_log_lines(commits).orderBy("commit_order").collect()
        latest = gitlog.latest_commits(commits, 100).orderBy("commit_order").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.hash for r in rows] == [f"h{i}" for i in range(400)]
    assert [r.record.split("|")[0] for r in latest] == [f"h{i}" for i in range(100)]


def test_history_keeps_first_commit(spark, tmp_path):
    secret = 'token = "' + "0f" * 20 + '"'
    text = "".join(
        f"COMMIT:h{i}|s{i}|a|d|m\ndiff --git a/f b/{p}\n@@ -0,0 +{i} @@\n+{secret}\n"
        for i, p in [(1, "a.py"), (2, "a.py"), (3, "b.py"), (4, "x.lock"), (5, "dummy_1.py")]
    )
    put(tmp_path, "r.log", text)
    lines = history.git_log_lines(gitlog.read_git_log(spark, str(tmp_path)))
    found = history.history_scan(lines, rules.builtin_secret_patterns(spark)).orderBy("file_path").collect()
    assert [(f.file_path, f.line_number, f.metadata["commit_short"]) for f in found] == [("a.py", 1, "s1"), ("b.py", 3, "s3")]
    assert "0f0f0f" not in found[0].evidence


def test_sast_reports(spark, tmp_path):
    from palisade.operators import analysers

    put(tmp_path, "scan7/semgrep.json", json.dumps({"results": [
        {"check_id": "c1", "path": "a.py", "start": {"line": 4}, "extra": {"message": "m" * 300, "severity": "error", "metadata": {"fix": ""}}}, {}]}))
    rows = analysers.semgrep_findings(reports.read_sast_reports(spark, str(tmp_path), "semgrep")).orderBy("position").collect()
    assert rows[0].scan_id == "scan7" and len(rows[0].title) == 200 and rows[0].severity == "high"
    assert rows[0].remediation.startswith("Review and remediate") and rows[0].references == []
    assert (rows[1].rule_id, rows[1].title, rows[1].severity, rows[1].line_number) == ("SEMGREP-UNKNOWN", "Semgrep finding", "low", None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "cve"), ("f2", "secret")], "finding_id string, category string")
    sinks.write_findings(rows, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.filter("category = 'cve'").count() == 1
    scans = spark.createDataFrame([("s1", "completed"), ("s2", "odd")], "scan_id string, status string")
    sinks.write_scans(scans.filter("status <> 'odd'"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    with pytest.raises(Exception, match="unknown scan status"):
        sinks.write_scans(scans, str(tmp_path / "s2"))
    assert back.select(F.count("*")).first()[0] == 2


def test_patterns_are_judged_by_the_jvm(spark, tmp_path):
    entries = [{"id": f"R{n}", "name": f"n{n}", "pattern": p} for n, p in enumerate(["[a&&[^b]]x", "\\p{Lu}x", "(", "(?P<n>a)(?P=n)", 7])]
    put(tmp_path, "r.json", json.dumps(entries))
    assert {r.rule_id for r in rules.read_rules(spark, str(tmp_path)).collect()} == {"R0", "R1", "R3"}
    assert {(r["name"], r.reason == "no text") for r in rules.refused_entries(spark, str(tmp_path)).collect()} == {("n2", False), ("n4", True)}
    names = {r["name"] for r in rules.read_secret_patterns(spark, str(tmp_path)).collect()}
    assert {"n0", "n1", "n3"} <= names and not {"n2", "n4"} & names


def test_many_rules(spark):
    """Some hundred rules in one pass."""
    from palisade.operators import detect
    from palisade.schemas import RULE

    n = 400
    table = spark.createDataFrame([(f"R{i:03}", "n", "", "high", "c", f"word{i}\\b", ["*"], "", [], []) for i in range(n)], RULE)
    files = spark.createDataFrame([("s", f"/f{k}.yml", "\n".join(f"word{i}" for i in range(k, n, 50))) for k in range(50)], "scan_id string, path string, content string")
    found = detect.rule_scan(files, table).select("file_path", "rule_id", "line_number").collect()
    assert {tuple(r) for r in found} == {(f"/f{k}.yml", f"R{i:03}", j + 1) for k in range(50) for j, i in enumerate(range(k, n, 50))}
