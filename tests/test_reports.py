"""Documents, compliance, intelligence, deduplication: literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.operators import compliance, dashboard, findings as stored, housekeeping, intel, sbom
from palisade.operators.manifests import requirements_includes
from palisade.plans.scan import FIRST, stored_findings
from palisade.sources import exports

SCANS = "scan_id string, target string, status string, scan_type string"
FINDINGS = ("finding_id string, scan_id string, rule_id string, title string, description string, severity string, category string, "
            "file_path string, line_number int, evidence string, remediation string, cve_id string, cvss_score double, is_fixed boolean")


def scans(spark, *ids):
    return spark.createDataFrame([(i, f"/srv/{i}", "completed", "full") for i in ids], SCANS)


def rows(spark, *items):
    base = dict(scan_id="1", rule_id="R", title="T", description="D", severity="high", category="secret", file_path="a\\b.py",
                line_number=3, evidence='say "x"\n', remediation="", cve_id=None, cvss_score=None, is_fixed=False)
    return spark.createDataFrame([{**base, "finding_id": f"f{i:03d}", **it} for i, it in enumerate(items)], FINDINGS)


def documents(lines):
    out = {}
    for r in lines.orderBy("scan_id", "section", "sort_key").collect():
        out[r.scan_id] = out.get(r.scan_id, "") + r.line + "\n"
    return {k: json.loads(v) for k, v in out.items()}


def test_json_report(spark):
    found = rows(spark, {}, {"severity": "odd", "category": "cve"}, {"scan_id": "2"})
    docs = documents(exports.to_json_report(found, scans(spark, "1", "2", "3")))
    assert docs["1"]["summary"] == {"total": 2, "by_severity": {"critical": 0, "high": 1, "medium": 0, "low": 0, "info": 1},
                                    "by_category": {"cve": 1, "secret": 1}}
    assert [f["finding_id"] for f in docs["1"]["findings"]] == ["f000", "f001"]
    assert docs["1"]["findings"][0]["evidence"] == 'say "x"\n' and docs["1"]["tool"]["name"] == "Palisade"
    assert docs["3"]["findings"] == [] and docs["3"]["summary"]["total"] == 0


def test_sarif(spark):
    found = rows(spark, {"rule_id": "B", "line_number": None}, {"rule_id": "A", "severity": "medium", "remediation": "do", "title": "first"},
                 {"rule_id": "A", "title": "second", "severity": "info"})
    doc = documents(exports.to_sarif(found, scans(spark, "1", "2"), ["finding_id"]))["1"]
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["B", "A"]
    assert run["tool"]["driver"]["rules"][1]["name"] == "first"
    assert run["tool"]["driver"]["rules"][1]["defaultConfiguration"]["level"] == "warning"
    assert [(r["ruleId"], r["ruleIndex"], r["level"]) for r in run["results"]] == [("B", 0, "error"), ("A", 1, "warning"), ("A", 1, "note")]
    first = run["results"][0]
    place = first["locations"][0]["physicalLocation"]
    assert place["artifactLocation"] == {"uri": "a/b.py", "uriBaseId": "%SRCROOT%"} and place["region"]["startLine"] == 1
    assert first["fingerprints"] == {"palisade/v1": "B:a\\b.py:1"}
    assert "fixes" not in first and run["results"][1]["fixes"] == [{"description": {"text": "do"}}]


def test_cyclonedx_keeps_equal_packages(spark):
    deps = spark.createDataFrame([("1", "a", "1", "npm"), ("1", "a", "1", "npm"), ("1", "b", "2", "pypi")],
                                 "scan_id string, name string, version string, ecosystem string")
    docs = documents(exports.to_cyclonedx(sbom.sbom_packages(deps, "MIT"), scans(spark, "1", "2")))
    assert [c["name"] for c in docs["1"]["components"]] == ["a", "a", "b"]
    assert docs["1"]["components"][2]["purl"] == "pkg:pypi/b@2" and docs["1"]["metadata"]["component"]["name"] == "1"
    assert docs["2"]["components"] == [] and docs["1"]["serialNumber"] != docs["2"]["serialNumber"]


def test_payload(spark):
    found = rows(spark, {"cve_id": "CVE-2020-0001", "category": "cve"}, {"severity": "low"})
    all_scans = scans(spark, "1", "2")
    kev = spark.createDataFrame([("CVE-2020-0001", "p", "bad")], "cve_id string, product string, short_description string")
    epss = spark.createDataFrame([("CVE-2020-0001", 0.9, 0.99)], "cve_id string, epss double, percentile double")
    mentions = intel.cve_mentions(found)
    doc = documents(exports.export_report_payload(
        all_scans, found, dashboard.scan_risk(found), dashboard.executive_summary(all_scans, found, "X"),
        dashboard.top_risks(found, intel.enrich_cves(mentions, kev, epss)),
        compliance.compliance_score(compliance.scan_controls(found, all_scans)),
        sbom.sbom_from_findings(all_scans, found, ["finding_id"]), intel.scan_records(mentions, kev, epss),
    ))
    assert doc["1"]["metrics"]["risk_score"] == 17 and doc["1"]["metrics"]["risk_label"] == "Low"
    assert [f["severity"] for f in doc["1"]["top_findings"]] == ["high", "low"]
    assert doc["1"]["compliance_alignments"]["nist-csf"] == {"score": 83.3, "passed": 5, "failed": 1}
    assert doc["1"]["threat_intelligence"][0]["priority"] == "immediate"
    assert "primary X vulnerability" in doc["2"]["summary"] and doc["2"]["all_findings"] == []


def test_written_document_in_parts(spark, tmp_path):
    found = spark.range(5000).select(
        F.format_string("f%06d", "id").alias("finding_id"), F.lit("1").alias("scan_id"), F.lit("high").alias("severity"),
        F.lit("cve").alias("category"), F.lit("x" * 50).alias("title"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        exports.write_documents(exports.to_json_report(found, scans(spark, "1", "2")), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out" / "scan_id=1").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and [f["finding_id"] for f in doc["findings"]] == [f"f{i:06d}" for i in range(5000)]


def test_compliance_global_and_per_scan(spark):
    found = rows(spark, {"category": "cve", "scan_id": "1"}, {"category": "secret", "severity": "critical", "scan_id": "2"})
    both = scans(spark, "1", "2")
    score = lambda **k: compliance.compliance_score(compliance.compliance_controls(found, both, "nist", **k)).first()
    assert score()[1:] == (6, 4, 2, 66.7)
    assert score(scan_id="1")[1:] == (6, 5, 1, 83.3)
    per_scan = compliance.compliance_score(compliance.scan_controls(found, both, "nist-csf")).collect()
    assert {r.score for r in per_scan} == {83.3}
    running = both.withColumn("status", F.lit("running"))
    assert compliance.compliance_controls(found, running, "soc2").filter("status = 'failed'").count() == 0
    with pytest.raises(ValueError, match="unsupported framework"):
        compliance.compliance_controls(found, both, "iso")


def test_keyword_controls(spark):
    hit = rows(spark, {"category": "secret", "title": "x"})
    controls = {r.control_id: r.status for r in compliance.keyword_controls(hit, "SOC-2").collect()}
    assert controls["SOC-2-001"] == "failed" and controls["SOC-2-010"] == "not-applicable" and controls["SOC-2-003"] == "passed"
    nothing = compliance.keyword_controls(hit.filter("false"))
    assert {r.status for r in nothing.collect()} == {"passed"}
    assert {r.score for r in compliance.keyword_score(nothing).collect()} == {100}


def test_intel_for_a_scan(spark):
    found = rows(spark, {"cve_id": "CVE-2023-0001", "cvss_score": 8.2}, {"title": "no id"},
                 {"scan_id": "2", "rule_id": "cve-2023-0002-x", "description": "see CVE-2023-0003 and CVE-2023-12"})
    mentions = {(r.scan_id, r.cve_id): r.cvss for r in intel.cve_mentions(found).collect()}
    assert mentions == {("1", "CVE-2023-0001"): 8.2, ("2", "CVE-2023-0002"): None, ("2", "CVE-2023-0003"): None}
    kev = spark.createDataFrame([], "cve_id string, product string, short_description string")
    epss = spark.createDataFrame([("CVE-2023-0001", 0.15, None)], "cve_id string, epss double, percentile double")
    record = intel.scan_records(intel.cve_mentions(found), kev, epss).filter("scan_id = '1'").first()
    assert (record.priority, record.sources, record.summary) == ("high", [], intel.NOT_LISTED)
    totals = {r.scan_id: r.total_cves for r in intel.intel_summary(scans(spark, "1", "2", "3"), intel.scan_records(intel.cve_mentions(found), kev, epss)).collect()}
    assert totals == {"1": 1, "2": 2, "3": 0}
    assert intel.enrich_cves(spark.createDataFrame([("junk",), (" cve-2023-0001 ",)], "cve_id string"), kev, epss).count() == 1


def test_dedupe_keeps_first_and_is_idempotent(spark):
    found = rows(spark, {"evidence": "AKIA" + "x" * 130, "title": "b"}, {"evidence": "AKIA" + "x" * 200, "title": "a"},
                 {"line_number": None}, {"line_number": 0}, {"scan_id": "2"})
    once = stored.dedupe_findings(found, ["finding_id"])
    assert sorted(r.finding_id for r in once.collect()) == ["f000", "f001", "f002", "f004"]
    assert stored.dedupe_findings(once, ["finding_id"]).count() == 4


def test_stored_findings_score_before_paths_are_cut(spark):
    from palisade.operators.common import finding

    raw = spark.range(2).select(finding(
        "misconfig", scan_id=F.lit("1"), rule_id=F.lit("R"), title=F.lit("T"), severity=F.lit("medium"), category=F.lit("misconfig"),
        file_path=F.lit("/tests/app/x.yml"), line_number=F.lit(1), evidence=F.lit(""), position=F.col("id"),
    ))
    files = spark.createDataFrame([("1", "/tests/app/x.yml", "first line\n")], "scan_id string, path string, content string")
    roots = spark.createDataFrame([("1", "/tests/app")], "scan_id string, root string")
    out = stored_findings(raw, files, roots).collect()
    assert [(r.file_path, r.final_score, r.evidence) for r in out] == [("x.yml", 4.0, "first line")]
    again = stored_findings(raw, files, roots).first()
    assert again.finding_id == out[0].finding_id and FIRST[0] == "detector"


def test_rollup_adds_up(spark):
    found = rows(spark, *[{"severity": s} for s in ["critical", "high", "medium", "low", "info", "info"]])
    r = stored.scan_rollup(scans(spark, "1", "2"), found).orderBy("scan_id").collect()
    assert r[0].total_findings == 6 == sum([r[0].critical_count, r[0].high_count, r[0].medium_count, r[0].low_count])
    assert r[0].low_count == 3 and r[1].total_findings == 0


def test_lookups_by_id(spark):
    assert stored.get_scan(scans(spark, "1"), "1").count() == 1
    with pytest.raises(stored.NotFound):
        stored.get_scan(scans(spark, "1"), "9")
    with pytest.raises(ValueError, match="unknown severity"):
        stored.filter_findings(rows(spark, {}), severity="bad")


def test_clear_history(spark):
    table = spark.createDataFrame([("1", "completed"), ("2", "running"), ("3", "running")], "scan_id string, status string")
    found = rows(spark, {"scan_id": "1"}, {"scan_id": "2"}, {"scan_id": "3"}, {"scan_id": "3"})
    active = spark.createDataFrame([("2",)], "scan_id string")
    kept, kept_findings, report = housekeeping.clear_history(table, found, active)
    assert [r.scan_id for r in kept.collect()] == ["2"] and kept_findings.count() == 1
    assert report.first().asDict() == {"deleted_scans": 2, "deleted_findings": 3}


def test_includes_in_a_circle(spark):
    files = spark.createDataFrame(
        [("s", "/p/a.txt", "-r sub/b.txt\nx==1"), ("s", "/p/sub/b.txt", "-r ../a.txt\n-r ./c.txt\n-r missing.txt"), ("s", "/p/sub/c.txt", "y")],
        "scan_id string, path string, content string",
    )
    got = requirements_includes(files, files.filter("path = '/p/a.txt'")).collect()
    assert sorted(r.path for r in got) == ["/p/a.txt", "/p/sub/b.txt", "/p/sub/c.txt"]


def test_trend_of_one_point(spark):
    trend = spark.createDataFrame([("h", 1, 2, 3, 4)], "hour string, critical bigint, high bigint, medium bigint, low bigint")
    assert [r.hour for r in dashboard.pad_trend(trend).collect()] == ["Start", "h"]
    assert dashboard.pad_trend(trend.union(trend)).count() == 2


def test_sql_over_results(spark):
    rows(spark, {}, {"severity": "low"}).createOrReplaceTempView("user_findings")
    got = spark.sql("SELECT severity, count(*) AS n FROM user_findings GROUP BY severity ORDER BY severity").collect()
    assert [(r.severity, r.n) for r in got] == [("high", 1), ("low", 1)]


def test_detectors_follow_scan_type(spark):
    from palisade.plans.scan import all_detectors
    from palisade.sources import rules as rule_source

    files = spark.createDataFrame(
        [(s, f"/{s}/nginx.conf", "debug = on\n4111111111111111\n") for s in ("full", "secrets", "misconfig", "drift", "sast")],
        "scan_id string, path string, content string",
    )
    table = files.select("scan_id", F.col("scan_id").alias("scan_type"))
    config = (rule_source.builtin_rules(spark), rule_source.builtin_secret_patterns(spark), rule_source.builtin_baselines(spark))
    history = all_detectors(files, table, *config).filter("category = 'secret'")
    found = all_detectors(files, table, *config, others={"sast": history.withColumn("scan_id", F.lit("sast")), "cve": history})
    got = {}
    for r in found.groupBy("scan_id", "category").count().collect():
        got.setdefault(r.scan_id, {})[r.category] = r["count"]
    assert got["secrets"] == {"secret": 1} and got["misconfig"] == {"misconfig": 1} and got["drift"] == {"drift": 4}
    assert got["full"] == {"secret": 2, "misconfig": 1, "drift": 4}
    assert got["sast"] == {"secret": 2}
    carried = all_detectors(files.withColumn("scan_type", F.col("scan_id")), table, *config)
    assert carried.count() == all_detectors(files, table, *config).count()
