"""Findings that are dealt by scan once: nothing behind moves them again, and all documents stay what they are."""

import re

import pytest
from pyspark.sql import functions as F

from palisade.operators import common, compliance, dashboard, intel, sbom
from palisade.sources import exports

SCANS = "scan_id string, target string, status string, scan_type string"
FINDINGS = ("finding_id string, scan_id string, rule_id string, title string, description string, severity string, category string, "
            "file_path string, line_number int, evidence string, remediation string, cve_id string, cvss_score double, is_fixed boolean")


@pytest.fixture(scope="module")
def found(spark):
    """One scan holds a third; ids repeat, rows come twice, and scans, rules, ids and CVEs are missing here and there."""
    return spark.range(0, 1000, 1, 6).selectExpr("IF(id >= 900, (id - 900) * 9 + 3, id) AS id").selectExpr(
        "CASE WHEN id % 41 = 0 THEN NULL WHEN id % 5 = 0 THEN 'same' ELSE format_string('f%05d', id) END AS finding_id",
        "CASE WHEN id % 53 = 0 THEN NULL WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 100) END AS scan_id",
        "CASE WHEN id % 37 = 0 THEN NULL ELSE concat('R', id % 11) END AS rule_id", "concat('t', id % 11) AS title", "'d' AS description",
        "element_at(array('critical', 'high', 'medium', 'low', 'odd'), int(id % 5 + 1)) AS severity",
        "element_at(array('cve', 'secret', 'drift'), int(id % 3 + 1)) AS category", "concat('a', id % 4) AS file_path", "int(id % 9) AS line_number",
        "concat('wide ', id) AS evidence", "IF(id % 2 = 0, 'do', '') AS remediation",
        "CASE WHEN id % 4 <> 0 THEN concat('cve-2020-', lpad(string(id % 13), 4, '0')) END AS cve_id", "double(id % 10) AS cvss_score", "id % 7 = 0 AS is_fixed",
    )


@pytest.fixture(scope="module")
def scans(spark):
    names = ["hot", "empty", None, *(f"s{i}" for i in range(100))]
    return spark.createDataFrame([(i, f"/srv/{i}", "completed", "full") for i in names], SCANS)


@pytest.fixture(scope="module")
def feeds(spark):
    """Some CVEs are listed twice."""
    kev = [(f"CVE-2020-{i:04}", "p", "bad") for i in (1, 2, 2, 5)]
    epss = [(f"CVE-2020-{i:04}", i / 13, i / 13) for i in (1, 3, 5, 5, 12)]
    return (spark.createDataFrame(kev, "cve_id string, product string, short_description string"),
            spark.createDataFrame(epss, "cve_id string, epss double, percentile double"))


def payload(found, scans, feeds, known, in_place=False):
    records = intel.scan_records(intel.cve_mentions(found), *feeds)
    return exports.export_report_payload(
        scans, found, dashboard.scan_risk(found), dashboard.executive_summary(scans, found), dashboard.top_risks(found, known, in_place=in_place),
        compliance.compliance_score(compliance.scan_controls(found, scans)),
        sbom.sbom_packages(found.filter("category = 'cve'").select("scan_id", F.col("rule_id").alias("name"), F.lit("1").alias("version"), F.lit("npm").alias("ecosystem"))),
        records, *[in_place] * in_place,
    )


def lines_of(lines):
    now = re.compile(r'"(startTimeUtc|endTimeUtc)":"[^"]*"')
    return sorted(((r.scan_id or "", r.section, r.sort_key or "", now.sub("", r.line or "")) for r in lines.collect()))


def shuffles(spark, df):
    """Columns that each shuffle of the last plan carries; one that is used again is counted once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return re.findall(r"[+:]- Exchange (?:hash|range|RoundRobin)[^\n]*\n[^\n]*Project \[([^\n]*)", text)


def test_one_shuffle_serves_all_that_is_asked_by_scan(spark, found):
    rows = common.dealt(found.select("scan_id", "finding_id", "category", "is_fixed"), "scan_id")
    few = rows.filter("category = 'cve'").groupBy("scan_id").agg(F.min("finding_id").alias("least"))
    both = rows.groupBy("scan_id").count().join(few, "scan_id", "left")
    assert len(shuffles(spark, both)) == 1
    assert rows.count() == found.filter("scan_id is not null").count()
    assert both.agg(F.sum("count")).first()[0] == rows.count()


def test_crowded_keys(spark, found, monkeypatch):
    assert common.crowded_keys(found, "scan_id") == ([], True)
    monkeypatch.setattr(common, "CROWDED_ROWS", 100)
    assert common.crowded_keys(found, "scan_id") == (["hot"], True)
    assert common.crowded_keys(found.filter("scan_id is not null"), "scan_id") == (["hot"], False)
    assert common.crowded_keys(found.filter("scan_id is null"), "scan_id") == ([], True)
    assert common.crowded_keys(found.filter("false"), "scan_id") == ([], False)


@pytest.mark.parametrize("of", ["sarif", "payload"])
def test_findings_reach_the_task_of_their_scan_in_one_shuffle(spark, found, scans, feeds, of):
    own = found.filter("scan_id is not null")
    if of == "sarif":
        lines = exports.to_sarif(own, scans, ["finding_id"])
    else:
        ((part, some, in_place),) = exports.scan_parts(own, scans)
        lines = payload(part, some, feeds, intel.enrich_cves(intel.cve_mentions(part), *feeds), in_place)
    moved = shuffles(spark, lines)
    for column in ("title", "evidence", "file_path", "finding_id"):
        assert len([x for x in moved if f"{column}#" in x]) == 1, column


def test_sarif_in_place_and_across_tasks(spark, found, scans, monkeypatch):
    order = ["finding_id", "title", "evidence"]
    lines = lambda: lines_of(exports.to_sarif(found, scans, order))
    in_place = lines()
    monkeypatch.setattr(common, "CROWDED_ROWS", 100)
    with_crowded = lines()
    monkeypatch.setattr(exports, "dealt", lambda rows, key: rows.filter("false"))
    assert 0 < len([x for x in lines() if x[0] == "hot"]) == len([x for x in in_place if x[0] == "hot"])
    assert in_place == with_crowded
    n = found.filter("rule_id is not null and scan_id is not null").count()
    assert len([x for x in in_place if x[1] == 3]) == n
    across = exports._sarif_items(found.filter("scan_id is not null"), order, "palisade/v1", False)
    assert lines_of(across) == [x for x in in_place if x[1] in (1, 3) and x[0]]


def test_payload_in_place_and_across_tasks(spark, found, scans, feeds, monkeypatch):
    known = intel.enrich_cves(intel.cve_mentions(found), *feeds)
    across = lines_of(payload(found, scans, feeds, known))
    for rows in (100_000, 100):
        monkeypatch.setattr(common, "CROWDED_ROWS", rows)
        parts = exports.scan_parts(found, scans)
        assert [x[2] for x in parts] == [True, False]
        got = [line for part, some, in_place in parts for line in lines_of(payload(part, some, feeds, known, in_place))]
        assert sorted(got) == across
    assert len([x for x in across if x[1] == 1]) == found.count()


def test_top_risks_in_place(found, feeds):
    rows = found.filter("scan_id is not null and finding_id <> 'same'").dropDuplicates(["finding_id"])
    known = intel.enrich_cves(intel.cve_mentions(rows), *feeds)
    assert known.count() > known.select("cve_id").distinct().count()
    columns = ["scan_id", "finding_id", "evidence", "points", "place"]
    got = dashboard.top_risks(common.dealt(rows, "scan_id"), known, in_place=True).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dashboard.top_risks(rows, known).select(columns).collect()))
    assert got.filter("points > 100").count() > 0
