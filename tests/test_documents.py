"""Documents stay valid whatever ids repeat, and come back from one table; advisories in any layout."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.operators import advisories as adv
from palisade.sources import exports, feeds

SCANS = "scan_id string, target string, scan_type string"
FOUND = "scan_id string, finding_id string, severity string, category string"


@pytest.fixture(scope="module")
def scans(spark):
    return spark.createDataFrame([(f"s{i}", "t", "full") for i in range(5)], SCANS)


@pytest.fixture(scope="module")
def found(spark):
    rows = [("s0", "a", "high", "x"), ("s0", "a", "high", "x"), ("s0", "a", "low", "y"), ("s0", "b", "low", "y"), ("s1", "z", "low", "y"), ("s2", "q", "high", "x"), ("s2", "q", "high", "x")]
    rows += [("s3", f"{i:05}", "info", "z") for i in range(3000)]
    return spark.createDataFrame(rows, FOUND).repartition(6)


def documents(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (r.scan_id, r.section, r.sort_key)):
        out.setdefault(r.scan_id, []).append(r.line)
    return {scan: json.loads("\n".join(parts)) for scan, parts in out.items()}


def test_equal_ids_are_two_elements(scans, found):
    docs = documents(exports.to_json_report(found, scans))
    ids = {scan: [f["finding_id"] for f in d["findings"]] for scan, d in docs.items()}
    assert ids["s0"] == ["a", "a", "a", "b"] and ids["s1"] == ["z"] and ids["s2"] == ["q", "q"] and ids["s4"] == [] and len(ids["s3"]) == 3000
    assert all(d["summary"]["total"] == len(ids[scan]) for scan, d in docs.items())


def test_documents_in_one_table(spark, scans, found, tmp_path):
    path = str(tmp_path / "docs")
    lines = exports.to_json_report(found, scans)
    exports.write_document_table(lines, path)
    files = [f for f in (tmp_path / "docs").iterdir() if f.suffix == ".parquet"]
    assert len(files) <= 8
    for scan, n in (("s0", 4), ("s3", 3000), ("s4", 0)):
        text = "\n".join(r.line for r in exports.read_document(spark, path, scan).collect())
        assert len(json.loads(text)["findings"]) == n
    assert exports.read_document(spark, path, "none").count() == 0
    plan = exports.read_document(spark, path, "s0")._jdf.queryExecution().toString()
    assert "EqualTo(scan_id,s0)" in plan.split("PushedFilters")[1][:120]


def test_null_scan(spark, scans):
    rows = spark.createDataFrame([(None, "a", "high", "x"), (None, "b", "high", "x")], FOUND)
    lines = exports.array_lines(rows, 1, F.col("finding_id"), F.lit("{}"))
    assert sorted(r.line for r in lines.collect()) == [",{}", "{}"]


def advisory(i):
    return {"id": f"OSV-{i}", "affected": [{"package": {"ecosystem": "PyPI", "name": f"p{i}"}, "versions": ["1.0"]}]}


def test_advisories_by_line_and_by_file(spark, tmp_path):
    for folder in ("lines", "files"):
        (tmp_path / folder).mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text("\n".join(json.dumps(advisory(i)) for i in range(3)) + '\n{"summary":"no id"}\n{ broken\n')
    for i in range(4):
        (tmp_path / "files" / f"{i}.json").write_text(json.dumps(advisory(i), indent=2))
    (tmp_path / "files" / "bad.json").write_text("{\n  nothing")
    (tmp_path / "files" / "nameless.json").write_text('{\n  "summary": "x"\n}')
    for folder, per, n in (("lines", "line", 3), ("files", "file", 4)):
        path = str(tmp_path / folder)
        table = feeds.read_advisories(spark, path, per)
        assert {r.osv_id for r in adv.advisory_flatten(table).collect()} == {f"OSV-{i}" for i in range(n)}
        assert table.columns == ["id", "summary", "details", "aliases", "severity", "database_specific", "affected", "references"]
        assert sorted(r.reason for r in feeds.nameless_advisories(spark, path, per).collect()) == ["no JSON", "no id"]
    with pytest.raises(ValueError):
        feeds.read_advisories(spark, str(tmp_path), "folder")
