"""Files read as chunks of lines: the same findings as from whole files, wherever chunks and splits end."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import detect
from palisade.schemas import CHECK, RULE
from palisade.sources import corpus, large, rules

SHOWN = ["scan_id", "file_path", "rule_id", "line_number", "evidence", "detector", "context_keyword"]


def put(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode("utf-8", "surrogateescape"))


def some_file(rng: random.Random, n: int) -> str:
    lines = ["", "debug = on", "password = hunter22", 'token = "' + "0f" * 20 + '"', "4111111111111111 and 4111111111111112", "begin", "payment card", "é🙂 ü", "bad \udcff byte", "x" * 90, "<link"]
    return "\n".join(rng.choice(lines) if rng.random() < 0.4 else "plain text " * rng.randint(0, 6) for _ in range(n)) + rng.choice(["", "\n", "\n\n"])


@pytest.fixture(scope="module")
def config(spark):
    rule = [("R1", "n", "", "high", "c", r"debug\s*=\s*on", ["*"], "", [], []), ("R2", "n", "", "low", "c", r"begin\n(?:.*\n){2}", ["*.yml"], "", [], []), ("R3", "n", "", "low", "c", "^$", ["*"], "", [], [])]
    check = [("nginx", f"C{i}", "n", "", "low", kind, pattern, "", []) for i, (kind, pattern) in enumerate([("must_exist", "<link"), ("must_exist", "never there"), ("must_not_exist", "debug"), ("must_not_match", r"begin\nplain"), ("must_match", "hunter")])]
    return spark.createDataFrame(rule, RULE), rules.builtin_secret_patterns(spark), spark.createDataFrame(check, CHECK)


@pytest.mark.parametrize(("split", "chunk"), [(10_000_000, 300), (700, 10_000), (60, 30), (4000, 900)])
def test_same_findings_as_from_whole_files(spark, tmp_path, config, split, chunk):
    rng = random.Random(split + chunk)
    n = 25 if split < 100 else 250
    for name in ("s1/app/settings.yml", "s1/nginx/nginx.conf", "s 2/a+b%20/nginx.conf", "s1/x.py"):
        put(tmp_path, name, some_file(rng, n))
    put(tmp_path, "s1/small.yml", "debug = on")
    root = str(tmp_path)
    whole = corpus.read_corpus(spark, root).filter("size_bytes > 20")
    want = sorted(map(tuple, detect.scan_files(whole, *config).select(SHOWN).collect()), key=repr)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        chunks = large.read_chunks(spark, root, above=20, chunk_bytes=chunk, margin=8)
        rows = chunks.collect()
        got = sorted(map(tuple, detect.scan_chunks(chunks, *config).select(SHOWN).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # whether the last line has an end is not known to chunks, so an empty one is not seen as one
    ends = {(r.path, r.content.count("\n") + k) for r in whole.collect() for k in (0, 1) if r.content.endswith("\n")}
    assert got == [r for r in want if r[2] != "R3" or (r[1], r[3]) not in ends]
    assert len(want) > 10 and {r[5] for r in want} == {2, 3, 4}
    assert len(rows) > 12
    for path, text in ((r.path, r.content) for r in whole.collect()):
        own = [line for r in sorted((r for r in rows if r.path == path), key=lambda r: r.first_line) for line in r.content.split("\n")[r.n_lead : r.n_lead + r.n_lines]]
        assert own == text.removesuffix("\n").split("\n")


def test_small_files_are_not_read(spark, tmp_path):
    put(tmp_path, "s/big.yml", "debug = on\n" * 100)
    put(tmp_path, "s/small.yml", "debug = on\n")
    chunks = large.read_chunks(spark, str(tmp_path), scan_id="own", above=500)
    assert {(r.scan_id, r.relative_path, r.n_lines, r.size_bytes) for r in chunks.collect()} == {("own", "s/big.yml", 100, 1100)}
    assert large.read_chunks(spark, str(tmp_path), above=10**9).count() == 0
    assert large.read_chunks(spark, str(tmp_path), above=0, glob="*.py").count() == 0


def test_a_large_file_in_many_tasks(spark, tmp_path, config):
    """40 MB in splits of 1 MB: no task holds much of it, and the one hit of each kind has its line."""
    with open(tmp_path / "huge.yml", "w") as f:
        for n in range(400_000):
            f.write("debug = on\n" if n in (7, 399_990) else f"line {n} {'y' * 85}\n")
    (tmp_path / "s").mkdir()
    (tmp_path / "huge.yml").rename(tmp_path / "s" / "huge.yml")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        chunks = large.read_chunks(spark, str(tmp_path), above=1000, chunk_bytes=200_000)
        most = chunks.select(F.length("content").alias("n")).agg(F.max("n"), F.count("*")).first()
        found = detect.scan_chunks(chunks, rules=config[0].filter("rule_id = 'R1'")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert most[0] < 250_000 and most[1] > 150
    assert sorted(r.line_number for r in found) == [8, 399_991]


def test_files_of_one_split_are_not_moved(spark, tmp_path):
    """Chunks of files that the reader never splits need no neighbours: they come without a join."""
    put(tmp_path, "s/a.yml", "debug = on\n" * 100)
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    chunks = large.read_chunks(spark, str(tmp_path), above=0, chunk_bytes=300, margin=2)
    assert spark.conf.get(name, None) == before
    plan = chunks._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Union":
        plan = plan.children().apply(0)  # before, a join was met here and no union
    assert "Join" not in plan.children().apply(0).toString()
    assert sum(r.n_lines for r in chunks.collect()) == 100
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        with pytest.raises(Exception, match="size of splits"):
            chunks.select("*").collect()
        chunks = large.read_chunks(spark, str(tmp_path), above=0, chunk_bytes=300, margin=2)
        assert sum(r.n_lines for r in chunks.collect()) == 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
