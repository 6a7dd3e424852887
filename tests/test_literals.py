"""Required texts and whole-text tests of patterns: they never rule out a text in which a line matches."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import detect
from palisade.operators.common import java_pattern
from palisade.operators.literals import matches_in_text, required_texts
from palisade.schemas import SECRET_PATTERN
from palisade.sources import rules


@pytest.mark.parametrize(("pattern", "texts"), [
    ("token", ["token"]), ("(?i)ToKen=[a-z]+", ["token="]), ("ab|cd", None), ("abc|xyz+", ["abc", "xyz"]), ("(?:password|passwd)\\s*=", ["passwd", "password"]),
    ("abcd?", ["abc"]), ("abc*", None), ("a{3}bcd", ["bcd"]), ("(abc)?longer", ["longer"]), ("(abc){0,2}", None), ("(abc)+", ["abc"]), ("x(?=hidden)yz", None), ("(?<!abc)defg", ["defg"]),
    ("\\babc\\b", ["abc"]), ("a\\.b\\-c", ["a.b-c"]), ("[abc]def", ["def"]), ("(?<name>abc)\\k<name>", None), ("(?x)a b c", None), ("(?u)task", None), ("(?-m:^token\\w+)", ["token"]),
    ("\\Qabc\\E", None), ("[a[bc]]def", None), ("[]]def", None), ("abc\\x41", None), ("(?>abc|abd)e", ["abc", "abd"]), ("é abc", [" abc"]), ("", None), ("(abc|)", None), ("abc)", None), ("(?(1)a|b)", None),
    ("(?:abc|def)ghijk", ["ghijk"]), ("-----BEGIN [A-Z ]*PRIVATE KEY-----", [*["private key-----"]]), ("\\p{Lu}abc\\P{L}", ["abc"]), ("abc++d", ["abc"]), ("(?s-i:abc)", ["abc"]),
])
def test_required_texts(pattern, texts):
    assert required_texts(pattern) == texts


@pytest.mark.parametrize(("pattern", "local"), [
    ("\\b[0-9]{13,19}\\b", True), ("^abc$", True), ("(?s).*", True), ("(?-m:^a)", False), ("\\Aa", False), ("a\\z", False), ("a(?=b)", False), ("(?<!a)b", False), ("a++", False), ("(?>a)", False), ("a+?", True), ("(?x)a", False),
])
def test_matches_in_text(pattern, local):
    assert matches_in_text(pattern) is local


FLAGS = [*[""] * 14, "(?i)", "(?-i)", "(?m)", "(?-m)", "(?s)", "(?d)", "(?x)", "(?u)", "(?i-s)", "(?U)", "(?-imsd)"]
PARTS = ["token", "to", "k", "\\b", "^", "$", "\\A", "\\z", "\\Z", "(?=o)", "(?!k)", "(?<=t)", "(?<!x)", "[a-k]", "[^a\\]]", ".", "\\w", "\\s", "\\.", "=", "(?:ab|token)", "(abc|tok|)", "(?>to|tok)", "(?-m:^to)", "(?i:EN)", "(?s:.)", "\\B", "\\n"]
REPEATS = [*[""] * 9, "?", "*", "+", "{2}", "{0,2}", "+?", "*+", "?+", "{1,}+"]


def some_pattern(rng: random.Random) -> str:
    branch = lambda: rng.choice(FLAGS) + "".join(p + (rng.choice(REPEATS) if p[0] not in "^$" and p not in ("\\A", "\\z", "\\Z", "\\b", "\\B") else "") for p in rng.choices(PARTS, k=rng.randint(1, 5)))
    return "|".join(branch() for _ in range(rng.choice([1, 1, 1, 2])))


def test_no_finding_is_lost(spark):
    """Random patterns of all flag groups over random texts, against each line by itself."""
    rng = random.Random(5)
    words = ["token", "TOKEN", "tok", "to", "k", "ab", "abc", "=", ".", " ", "en", "x", "é", "K", "\r", "1"]
    texts = ["\n".join("".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    files = spark.createDataFrame([("s", f"/f{k}.py", t) for k, t in enumerate(texts)], "scan_id string, path string, content string").cache()
    lines = [(k, n, line) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1)]
    table = spark.createDataFrame(lines, "f int, n int, line string").cache()
    chosen = list(dict.fromkeys(some_pattern(rng) for _ in range(300)))
    usable = detect.usable_rows(spark.createDataFrame([(f"p{i:03}", p, "high", "", []) for i, p in enumerate(chosen)], SECRET_PATTERN))
    assert len(usable) > 150
    proven = sum(bool(required_texts(java_pattern(r["pattern"]))) or matches_in_text(java_pattern(r["pattern"])) for r in usable)
    assert proven > 40
    hits = 0
    for at in range(0, len(usable), 20):
        some = usable[at : at + 20]
        found = detect.secret_scan(files, spark.createDataFrame(some, SECRET_PATTERN)).select("file_path", "line_number", "title").collect()
        plain = table.select("f", "n", F.array_compact(F.array(*[F.when(F.col("line").rlike(java_pattern(r["pattern"])), r["name"]) for r in some])).alias("names"))
        want = {(f"/f{r.f}.py", r.n, name) for r in plain.collect() for name in r.names}
        assert {tuple(r) for r in found} == want
        hits += len(want)
        # each pattern by itself, so that no other one keeps its text alive
        for r in some[:3]:
            alone = detect.secret_scan(files, spark.createDataFrame([r], SECRET_PATTERN)).select("file_path", "line_number", "title").collect()
            assert {tuple(x) for x in alone} == {w for w in want if w[2] == r["name"]}
    assert hits > 500


def test_shipped_patterns_are_proven(spark):
    for r in rules.builtin_secret_patterns(spark).collect():
        pattern = java_pattern(r["pattern"])
        assert required_texts(pattern) or matches_in_text(pattern)
