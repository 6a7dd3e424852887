"""Input that does not parse, patterns of other dialects, includes: nothing else is lost."""

from __future__ import annotations

import json

import pytest

from palisade.operators import detect, manifests
from palisade.operators.common import refused_patterns
from palisade.schemas import CHECK, RULE, SECRET_PATTERN

FILES = "scan_id string, path string, content string"


def secret(spark, *patterns):
    rows = [(f"p{n}", p, "high", "", []) for n, p in enumerate(patterns)]
    return spark.createDataFrame(rows, SECRET_PATTERN)


PATTERNS = [r"token=[^;]*+$", r"(['\"])abc\1", r"(?<=key=)zz", r"(?P<q_1>x)yz(?P=q_1)", r"foo;"]


@pytest.mark.parametrize("chosen", [[p] for p in PATTERNS] + [PATTERNS, PATTERNS[::-1]])
def test_patterns_find_the_same_alone_and_together(spark, chosen):
    text = "token=abc\nfoo;\n'abc'\nkey=zz\nxyzx\nnothing"
    line = {PATTERNS[0]: 1, PATTERNS[1]: 3, PATTERNS[2]: 4, PATTERNS[3]: 5, PATTERNS[4]: 2}
    files = spark.createDataFrame([("s", "/a.txt", text)], FILES)
    found = detect.secret_scan(files, secret(spark, *chosen)).collect()
    assert sorted(r.line_number for r in found) == sorted(line[p] for p in chosen)
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "line string")
    hits = detect.pattern_hits(lines, secret(spark, *chosen).collect()).collect()
    assert len(hits) == len(chosen)


def test_refused_patterns_are_listed_and_the_others_run(spark):
    files = spark.createDataFrame([("s", "/nginx.conf", "abc")], FILES)
    patterns = secret(spark, "(", "abc", "a{2,1}")
    assert [r.evidence for r in detect.secret_scan(files, patterns).collect()] != []
    assert {r.pattern for r in refused_patterns(patterns).collect()} == {"(", "a{2,1}"}
    rules = spark.createDataFrame([(f"R{n}", "n", "", "high", "c", p, ["*"], "", [], []) for n, p in enumerate(["(", "b"])], RULE)
    assert [r.rule_id for r in detect.rule_scan(files, rules).collect()] == ["R1"]
    checks = spark.createDataFrame([("nginx", f"C{n}", "n", "", "high", "must_exist", p, "", []) for n, p in enumerate(["(", "zz"])], CHECK)
    assert [r.rule_id for r in detect.drift_scan(files, checks).collect()] == ["C1"]


def test_broken_lock_files_do_not_hide_the_others(spark):
    text = '{"dependencies": {"top": ' + "".join(f'{{"version": "1", "dependencies": {{"d{n}": ' for n in range(400)) + '{"version": "2"}' + "}}" * 400 + "}}"
    rows = [
        ("s", "/a/package-lock.json", "{ broken"), ("s", "/b/package-lock.json", '{"dependencies": {"x": "1.0", "y": {"version": "2"}}}'),
        ("s", "/c/package-lock.json", "[]"), ("s", "/d/package-lock.json", text), ("s", "/e/package.json", "nope"),
    ]
    files = spark.createDataFrame(rows, FILES)
    found = manifests.npm_lock(files.filter("path like '%lock%'")).collect()
    assert {(r.path, r.name) for r in found if r.path == "/b/package-lock.json"} == {("/b/package-lock.json", "y")}
    assert sum(r.path == "/d/package-lock.json" for r in found) == 401
    assert {r.path for r in manifests.unreadable_manifests(files).collect()} == {"/a/package-lock.json", "/e/package.json"}
    assert sum(r.path == "/d/package-lock.json" and r.is_transitive for r in found) == 400
    nothing = spark.createDataFrame([("s", "/n/package-lock.json", json.dumps({"dependencies": None}))], FILES)
    assert manifests.npm_lock(nothing).count() == 0


def test_an_odd_entry_costs_that_entry_only(spark):
    rows = [
        ("s", "/a/package-lock.json", '{"lockfileVersion":3,"packages":{"":{},"node_modules/good":{"version":"1"},"node_modules/bad":"str","node_modules/none":null}}'),
        ("s", "/b/package-lock.json", '{"dependencies":{"x":{"version":"1","dependencies":{"y":7,"z":{"dev":true}}}}}'),
        ("s", "/c/Pipfile.lock", '{"default":{"A":{"version":"==1.2"},"b":"*"},"develop":{"t":{}}}'), ("s", "/d/Pipfile.lock", '{"default":[1],"develop":{"u":{}}}'),
        ("s", "/e/pom.xml", "<project><dependencies>"), ("s", "/f/package.json", '{"dependencies":"x"}'), ("s", "/g/package.json", None), ("s", "/h/Pipfile.lock", "[]"),
        ("s", "/i/package.json", '{"dependencies":null}'), ("s", "/j/pom.xml", "<project/>"), ("s", "/k/readme.md", None),
    ]
    files = spark.createDataFrame(rows, FILES)
    found = manifests.dependencies(files).collect()
    assert {(r.path[1], r.name, r.version, r.is_dev, r.is_transitive) for r in found} == {
        ("a", "good", "1", False, False), ("b", "x", "1", False, False), ("b", "z", "0.0.0", True, True),
        ("c", "a", "1.2", False, False), ("c", "t", "0.0.0", True, False), ("d", "u", "0.0.0", True, False),
    }
    assert {(r.path[1], r.place, r.reason) for r in manifests.manifest_faults(files).collect()} == {
        ("a", "node_modules/bad", "no object"), ("a", "node_modules/none", "no object"), ("b", "x/y", "no object"), ("c", "default/b", "no object"),
        ("d", "default", "no object"), ("e", None, "no XML"), ("f", "dependencies", "no object"), ("g", None, "no text"), ("h", None, "no object"),
    }


def test_manifests_of_skipped_folders_are_not_read(spark):
    rows = [("s", f"{folder}/package.json", '{"dependencies":{"a":"1"}}') for folder in ("/srv/x", "/srv/node_modules/y", "/srv/dist")]
    assert [r.path for r in manifests.dependencies(spark.createDataFrame(rows, FILES)).collect()] == ["/srv/x/package.json"]


def test_lock_plans_have_no_python(spark):
    files = spark.createDataFrame([("s", "/b/package-lock.json", '{"dependencies":{"x":{}}}')], FILES)
    plan = manifests.npm_lock(files)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Python" not in plan


def test_included_requirements_are_read(spark):
    rows = [
        ("s", "/r/requirements.txt", "a==1\n-r base/common.txt\n-r gone.txt"), ("s", "/r/base/common.txt", "flask==2\n-r ../more.in"),
        ("s", "/r/more.in", "-r base/common.txt\ndjango==3"), ("s", "/r/other.txt", "never==1"), ("t", "/r/base/common.txt", "foreign==1"),
    ]
    found = manifests.dependencies(spark.createDataFrame(rows, FILES)).collect()
    assert {(r.scan_id, r.name) for r in found} == {("s", "a"), ("s", "flask"), ("s", "django")}
