"""Fixes applied to file tables."""

import pytest

from palisade.operators import remediate as fix

FINDING = ("finding_id string, scan_id string, rule_id string, title string, category string, file_path string, line_number int, "
           "evidence string, cve_id string, is_fixed boolean, package string, fixed_version string")


def files(spark, **texts):
    return spark.createDataFrame([("s", p.replace("_", "."), t) for p, t in texts.items()], "scan_id string, path string, content string")


def found(spark, *rows):
    base = dict(scan_id="s", rule_id="WEB-001", title="t", category="misconfig", line_number=1, evidence="", cve_id=None,
                is_fixed=False, package=None, fixed_version=None)
    return spark.createDataFrame([{**base, "finding_id": f"f{i}", **r} for i, r in enumerate(rows)], FINDING)


def applied(spark, table, findings):
    changed, ids = fix.apply_fixes(table, findings, ["finding_id"])
    return {r.path: r.content for r in changed.collect()}, sorted(r.finding_id for r in ids.collect())


DEBUG = "DEBUG = False  # Fixed: debug mode disabled for production"


def test_debug_line(spark):
    out, ids = applied(spark, files(spark, a_conf="DEBUG = True\n", b_conf="x"), found(spark, {"file_path": "a.conf"}))
    assert out == {"a.conf": DEBUG + "\n"} and ids == ["f0"]


def test_windows_line_ends_and_no_final_newline(spark):
    out, _ = applied(spark, files(spark, a_conf="a\r\nDEBUG\r\nb"), found(spark, {"file_path": "a.conf", "line_number": 2}))
    assert out == {"a.conf": f"a\r\n{DEBUG}\nb"}


def test_line_beyond_the_file_is_not_applied(spark):
    out, ids = applied(spark, files(spark, a_conf="a\n"), found(spark, {"file_path": "a.conf", "line_number": 2}))
    assert out == {} and ids == []


def test_secret_forms(spark):
    secret = dict(category="secret", rule_id="SECRET-001")
    out, _ = applied(
        spark,
        files(spark, a_py="k = 'x'\n", b_yml="k: v\n", c_ts="k = v", d_java="String k = v;", e_txt="k", prod_env="Key = v"),
        found(spark, *[{"file_path": p, **secret} for p in ("a.py", "b.yml", "c.ts", "d.java", "e.txt", "prod.env")]),
    )
    assert out == {
        "a.py": "k = __import__('os').environ.get('SECRET_001')\n",
        "b.yml": 'k: "PLACEHOLDER_SECRET_001"\n',
        "c.ts": "k = process.env.SECRET_001",
        "d.java": 'String k = System.getenv("SECRET_001")',
        "e.txt": "SECRET-001_VALUE=${{ secrets.SECRET_001 }}",
        "prod.env": "Key =your_key_here",
    }


def test_user_line_cors_and_last_fix_wins(spark):
    out, ids = applied(
        spark,
        files(spark, Dockerfile="FROM a\nRUN x\n", n_conf="add_header 'Access-Control-Allow-Origin' '*';\n", c_py="Access-Control-Allow-Origin: *\n"),
        found(
            spark,
            {"file_path": "Dockerfile", "rule_id": "ACME-INFRA-001"}, {"file_path": "n.conf", "rule_id": "WEB-003"},
            {"file_path": "c.py", "rule_id": "WEB-001"}, {"file_path": "c.py", "rule_id": "WEB-003"},
        ),
    )
    assert out["Dockerfile"] == "FROM a\nUSER appuser\nRUN x\n"
    assert out["n.conf"] == "add_header 'Access-Control-Allow-Origin' 'https://yourdomain.com';\n"
    assert out["c.py"] == 'Access-Control-Allow-Origin: "https://yourdomain.com"\n'
    assert ids == ["f0", "f1", "f2", "f3"]


def test_package_lines(spark):
    cve = dict(category="cve", rule_id="CVE-1", cve_id="CVE-1")
    out, ids = applied(
        spark,
        files(spark, requirements_txt="a==1\nreq==1\nlib==2\nreq-x==1\n"),
        found(
            spark,
            {"file_path": "requirements.txt", "line_number": 3, "evidence": "req==1", "fixed_version": "2.31.0", **cve},
            {"file_path": "requirements.txt", "line_number": 3, "evidence": "lib==2", "fixed_version": "2.5", **cve},
            {"file_path": "requirements.txt", "line_number": 0, "evidence": "gone==2", "fixed_version": "3", **cve},
            {"file_path": "requirements.txt", "line_number": 1, "evidence": "a==1", **cve},
        ),
    )
    assert out == {"requirements.txt": "a==1\nreq>=2.31.0  # Fixes CVE-1\nlib>=2.5  # Fixes CVE-1\nreq-x==1\n"}
    assert ids == ["f0", "f1"]


def test_fixed_and_unfixable_are_left(spark):
    out, ids = applied(
        spark, files(spark, a_conf="DEBUG\n"),
        found(spark, {"file_path": "a.conf", "is_fixed": True}, {"file_path": "a.conf", "category": "sast"}),
    )
    assert out == {} and ids == []


def python_replace(content, text, start, end):
    """What editing the lines of a file in place gives."""
    lines, new = content.splitlines(keepends=True), text.splitlines(keepends=True)
    if new and not new[-1].endswith("\n") and len(lines) >= end and lines[end - 1].endswith("\n"):
        new[-1] += "\n"
    return "".join(lines[: start - 1] + new + lines[end:])


@pytest.mark.parametrize("content", ["a\nb\nc\n", "a\nb\nc", "a"])
@pytest.mark.parametrize("text", ["X\nY\n", "X\nY", "", "X\n"])
def test_replace_block(spark, content, text):
    spans = [(s, e) for s in (1, 2, 3) for e in (1, 2, 3, 4) if e >= s and s <= len(content.splitlines())]
    table = spark.createDataFrame([("s", f"{s}-{e}", content) for s, e in spans], "scan_id string, path string, content string")
    edits = spark.createDataFrame(
        [("s", f"{s}-{e}", s, e, text) for s, e in spans], "scan_id string, path string, start_line int, end_line int, text string"
    )
    got = {r.path: r.content for r in fix.replace_block(table, edits).collect()}
    assert got == {f"{s}-{e}": python_replace(content, text, s, e) for s, e in spans}


def test_revert_gives_the_file_back(spark):
    table = files(spark, a_conf="PORT = 8080\nDEBUG = True\nCORS = '*'\n")
    changed, ids = fix.apply_fixes(table, found(spark, {"file_path": "a.conf", "line_number": 2}), ["finding_id"])
    edits = spark.createDataFrame([("s", "a.conf", 2, 2, "DEBUG = True")], "scan_id string, path string, start_line int, end_line int, text string")
    assert [r.content for r in fix.replace_block(changed, edits).collect()] == [r.content for r in table.collect()]
    flipped, audit = fix.mark_fixed(found(spark, {"file_path": "a.conf", "is_fixed": True}), ids, revert=True)
    assert [r.is_fixed for r in flipped.collect()] == [False]
    assert [(r.action, r.target, r.status) for r in audit.collect()] == [("Reverted Auto-Fix: t", "a.conf:L1", "warning")]


def test_suggest_patch(spark):
    rows = found(
        spark,
        {"file_path": "a.conf", "evidence": "DEBUG = True"}, {"file_path": "r.txt", "category": "cve", "evidence": "req==1", "fixed_version": "2.31.0"},
        {"file_path": "x", "category": "sast", "rule_id": "B1"}, {"file_path": "a.conf", "category": "secret", "rule_id": "S-1", "evidence": "old"},
    )
    table = files(spark, a_conf="key = 1  \n")
    got = {r.finding_id: r.patch for r in fix.suggest_patch(rows, table).collect()}
    assert got["f0"] == f"--- a/a.conf\n+++ b/a.conf\n@@ -1,1 +1,1 @@\n-DEBUG = True\n+{DEBUG}"
    assert got["f1"].endswith("-req==1\n+req>=2.31.0  # Fixes known vulnerability")
    assert got["f2"] == "# Manual review required for B1"
    assert got["f3"].endswith("-key = 1\n+key =PLACEHOLDER_S_1")
    custom = {r.finding_id: r.patch for r in fix.suggest_patch(rows, custom="mine").collect()}
    assert custom["f0"].endswith("-DEBUG = True\n+mine")


def test_context_of_missing_file(spark):
    rows = found(spark, {"file_path": "nowhere", "line_number": 4, "evidence": "a\nb\n"}, {"file_path": "here.py", "line_number": 9})
    got = {r.finding_id: r for r in fix.finding_context(rows, files(spark, here_py="\n".join(str(i) for i in range(1, 12)) + "\n")).collect()}
    assert [(x.num, x.content) for x in got["f0"].lines] == [(4, "a"), (5, "b")] and got["f0"].end_line == 5
    assert [x.num for x in got["f1"].lines] == list(range(2, 12)) and got["f1"].end_line == 11


def test_findings_are_made_once(spark):
    """Findings that come from a long job are asked for only once, however often fixes need them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame([("s", "a.conf", "x\ndebug = on\nz"), ("s", "requirements.txt", "q\nlib==1.0")], "scan_id string, path string, content string")
    rows = [("1", "misconfig", "a.conf", 2, None, None), ("2", "cve", "requirements.txt", 0, "lib", "2.0")]
    columns = "finding_id string, category string, file_path string, line_number int, package string, fixed_version string"
    findings = spark.createDataFrame(rows, columns).selectExpr("*", "'s' AS scan_id", "'R' AS rule_id", "'C-1' AS cve_id", "'e' AS evidence", "false AS is_fixed")
    changed, ids = fix.apply_fixes(table, findings.mapInArrow(counted, findings.schema), ["finding_id"])
    assert {r.path: r.content for r in changed.collect()} == {"a.conf": f"x\n{fix.DEBUG_OFF}\nz", "requirements.txt": "q\nlib>=2.0  # Fixes C-1"}
    assert {r.finding_id for r in ids.collect()} == {"1", "2"}
    assert made.value == 2
