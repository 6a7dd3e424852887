"""Text detectors against a plain Python loop over the same texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palisade.operators import detect, directives
from palisade.operators.scoring import BANKING_WORDS
from palisade.sources import rules as rule_source
from palisade.sources.rules import rule_rows

FILES = "scan_id string, path string, content string"


def files(spark, *rows):
    return spark.createDataFrame([("s", p, text) for p, text in rows], FILES)


def rule_table(spark, *entries):
    rows = rule_rows([{"name": e["id"], **e} for e in entries])
    return spark.createDataFrame(rows, rule_source.schemas.RULE)


def expected(rules, texts):
    out = []
    for path, text in texts:
        lines = text.split("\n")
        for rule in rules:
            for m in re.finditer(rule["pattern"], text, re.I | re.M):
                line = text[: m.start()].count("\n") + 1
                near = "\n".join(lines[max(0, line - 3) : line + 2])
                words = any(w in near.lower() for w in BANKING_WORDS)
                out.append((path, rule["id"], line, m.group(0)[:200], words, near))
    return sorted(out)


RULES = [
    {"id": "SPAN", "pattern": r"key\s*[:=]\s*[a-z]+"},
    {"id": "START", "pattern": r"^a.*$"},
    {"id": "LONG", "pattern": r"z+"},
    {"id": "NUMBER", "pattern": r"\b[0-9]{2,}\b"},
    {"id": "LOOK", "pattern": r"b(?!c)"},
    {"id": "GROUP", "pattern": r"(x)(y)?"},
]


def random_texts(n, seed):
    rnd = random.Random(seed)
    pieces = ["key", "=", ":", " ", "\n", "\n\n", "a", "abc", "bc", "zzz", "z" * 230, "12", "345", "x", "xy", "wallet",
              "", "$0", "\\", "é", "\t", "KEY", "pan"]
    return [(f"/f{i}.yml", "".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 60)))) for i in range(n)]


def test_rule_scan_equals_a_loop(spark):
    texts = random_texts(150, 7)
    found = detect.rule_scan(files(spark, *texts), rule_table(spark, *RULES), keep_context_text=True).collect()
    got = sorted(
        (r.file_path, r.rule_id, r.line_number, r.evidence, r.context_keyword, r.metadata["context"]) for r in found
    )
    want = expected(RULES, texts)
    assert len(want) > 500
    # the text of a context has no empty line at the end of a file
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5].rstrip("\n") for g in got] == [w[5].rstrip("\n") for w in want]


def test_many_matches_in_one_text(spark):
    text = "\n".join("a1 zz" * 3 for _ in range(20000))
    found = detect.rule_scan(files(spark, ("/big.yml", text)), rule_table(spark, RULES[2]))
    assert found.count() == 60000
    assert found.agg(F.max("line_number"), F.countDistinct("position")).first()[:] == (20000, 60000)


def test_positions_follow_rule_then_match(spark):
    found = detect.rule_scan(files(spark, ("/f.yml", "x\nzz\nx 12")), rule_table(spark, RULES[5], RULES[2]))
    assert [(r.rule_id, r.line_number) for r in found.orderBy("position").collect()] == [
        ("GROUP", 1), ("GROUP", 3), ("LONG", 2)
    ]


def test_globs_and_config_files(spark):
    table = rule_table(spark, {"id": "A", "pattern": "x", "file_types": ["*.conf", "Dockerfile.*"]})
    rows = files(spark, *[(p, "x") for p in ("/a/b.conf", "/a/Dockerfile.x", "/a/c.py", "/a/node_modules/d.conf")])
    assert sorted(r.file_path for r in detect.rule_scan(rows, table).collect()) == [
        "/a/Dockerfile.x", "/a/b.conf", "/a/node_modules/d.conf"
    ]
    only = detect.scan_files(rows, rules=table, only_config=True)
    assert [r.file_path for r in only.collect()] == ["/a/b.conf"]


def test_from_rule_fires_on_every_from_line(spark):
    found = detect.rule_scan(
        files(spark, ("/a/Dockerfile", "FROM a:1\nUSER app\nFROM b:2\n")), rule_source.builtin_rules(spark)
    )
    assert sorted((r.rule_id, r.line_number) for r in found.collect()) == [("INFRA-001", 1), ("INFRA-001", 3)]


def test_builtin_rules_on_settings(spark):
    text = "PORT = 8080\nDEBUG = True\napi_key = \"abcdefghij0123456789\"\ndb_password = 'hunter22'\npassword: admin\ncvv: 123\n"
    found = detect.rule_scan(files(spark, ("/a/settings.conf", text)), rule_source.builtin_rules(spark, "ACME-"))
    assert {(r.rule_id, r.line_number) for r in found.collect()} == {
        ("ACME-WEB-001", 2), ("ACME-SECRET-001", 3), ("ACME-SECRET-002", 4), ("ACME-DB-001", 5), ("BANK-001", 6)
    }


def test_secret_scan_equals_a_loop(spark):
    rnd = random.Random(3)
    pieces = ["4111111111111111", "123", "\n", " ", 'token = "' + "0a" * 20 + '"', "AKIA" + "Z" * 16, "x"]
    texts = [(f"/f{i}", "".join(rnd.choice(pieces) for _ in range(25))) for i in range(80)]
    table = rule_source.builtin_secret_patterns(spark)
    want = sorted(
        (path, no, p.name)
        for path, text in texts
        for no, line in enumerate(text.split("\n"), 1)
        for p in table.collect()
        if re.search(p.pattern, line, re.I | re.M)
    )
    got = sorted((r.file_path, r.line_number, r.title) for r in detect.secret_scan(files(spark, *texts), table).collect())
    assert got == want and len(want) > 50


def test_pattern_with_look_behind_is_tested_per_line(spark):
    table = spark.createDataFrame([("P", r"(?<!\s)key", "high", "", [])], rule_source.schemas.SECRET_PATTERN)
    found = detect.secret_scan(files(spark, ("/a", "x\nkey")), table).collect()
    assert [r.line_number for r in found] == [2]


def test_drift(spark):
    docker = "FROM a:latest\nUSER root\nRUN apt-get install x\nADD --chown=1 a b\n"
    rows = files(spark, ("/a/Dockerfile", docker), ("/b/dockerfile.dev", "FROM a:1\n\n USER app\nHEALTHCHECK x\n"), ("/c/x.py", docker))
    found = detect.drift_scan(rows, rule_source.builtin_baselines(spark)).collect()
    assert sorted((r.file_path, r.rule_id, r.line_number) for r in found) == [
        ("/a/Dockerfile", "DRIFT-DOCKER-001", 0), ("/a/Dockerfile", "DRIFT-DOCKER-002", 1),
        ("/a/Dockerfile", "DRIFT-DOCKER-003", 0), ("/a/Dockerfile", "DRIFT-DOCKER-005", 3),
    ]
    latest = next(r for r in found if r.rule_id == "DRIFT-DOCKER-002")
    assert latest.evidence == "FROM a:latest" and latest.metadata["drift_detail"] == "Insecure pattern matched: FROM a:latest"
    assert latest.category == "drift" and latest.metadata["config_type"] == "Dockerfile"


def test_one_pass_equals_three(spark):
    rows = files(spark, ("/s/nginx.conf", "listen = 0.0.0.0\n4111111111111111\nserver_tokens off;"), ("/s/a.env", "debug = on"))
    rules, patterns, checks = (
        rule_source.builtin_rules(spark), rule_source.builtin_secret_patterns(spark), rule_source.builtin_baselines(spark)
    )
    key = ["file_path", "rule_id", "line_number", "evidence", "detector", "category", "position"]
    together = detect.scan_files(rows, rules, patterns, checks).select(*key)
    apart = detect.rule_scan(rows, rules).unionByName(detect.secret_scan(rows, patterns)).unionByName(
        detect.drift_scan(rows, checks)
    )
    drop = [k for k in key if k != "position"]
    assert sorted(map(tuple, together.select(*drop).collect())) == sorted(map(tuple, apart.select(*drop).collect()))


def test_too_many_rules_are_refused(spark):
    from palisade.operators.common import small_rows

    with pytest.raises(ValueError, match="configuration rows"):
        small_rows(spark.range(20), 10)


def test_directives(spark):
    docker = "# c\nfrom a:1\nRUN x \\\n  # note\n\n  y \\\n z\nCMD\nRUN open \\\n"
    got = directives.dockerfile_directives(files(spark, ("/D", docker))).orderBy("line").collect()
    assert [(r.instruction, r.arguments, r.line) for r in got] == [("FROM", "a:1", 2), ("RUN", "x y z", 7), ("CMD", "", 8)]
    nginx = "a b;\n}\nhttp {\n server { \n  listen 80;\n }\n gzip on;\n}\n"
    got = directives.nginx_directives(files(spark, ("/n", nginx))).orderBy("line").collect()
    assert [(r.directive, r.value, r.line, r.block) for r in got] == [
        ("a", "b", 1, ""), ("listen", "80", 5, "http/server"), ("gzip", "on", 7, "http")
    ]
