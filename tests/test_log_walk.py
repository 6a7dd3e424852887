"""Line-wise walk through git dumps: the same lines as from whole commit records, wherever splits and files end."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import history, log_walk
from palisade.sources import gitlog, rules

COLUMNS = ["repo", "hash", "author", "message", "file_no", "path", "line_number", "line"]


def put(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def some_log(seed: int, n: int) -> str:
    """Commits of all shapes: many files, no files, broken headers, odd hunks, marks where none belong."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(f"COMMIT:h{i}|s{i}|dev|2025|message {i} | more" if rng.random() < 0.9 else f"COMMIT:broken {i}")
        out += rng.choice([[""], ["", "@@ +9 in a message", "+no line"], ["diff --git without paths", "-x"]])
        for k in range(rng.choice([0, 1, 1, 2, 5])):
            out.append(f"diff --git a/d/f{k} b/d/f{k} b/x.py")
            out += rng.choice([[], ["new file mode 100644", "--- /dev/null", "+++ b/d"], ["Binary files differ"], ["+before a hunk", " x"]])
            for _ in range(rng.choice([0, 1, 1, 3])):
                out.append(rng.choice([f"@@ -1,2 +{rng.randint(0, 90)},4 @@ def f", "@@ odd", "@@ -0,0 +99999999999 @@", f"@@@ -1 -2 +{i + 1} @@@"]))
                out += [rng.choice(["+", "-", " ", "+++", "\\ ", "+é🙂", "", "+COMMIT:", "+diff --git a/x b/x", "-@@"]) + "w" * rng.randint(0, 30) for _ in range(rng.randint(0, 12))]
    return "\n".join(out) + rng.choice(["", "\n"])


def lines_of(spark, path, n_bytes, whole):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n_bytes))
    try:
        if whole:
            rows = history.git_log_lines(gitlog.read_git_log(spark, path))
        else:
            rows = log_walk.added_lines(gitlog.read_git_lines(spark, path))
        return [tuple(r) for r in rows.orderBy("repo", "commit_order", "file_no", "line_number", "line").select(COLUMNS).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("n_bytes", [40, 700, 10_000_000])
def test_same_lines_as_from_records(spark, tmp_path, n_bytes):
    for repo in range(3 if n_bytes > 40 else 1):
        put(tmp_path, f"r{repo}.log", some_log(repo + n_bytes, 40 if n_bytes > 40 else 12))
    want = lines_of(spark, str(tmp_path), 10_000_000, True)
    assert len(want) > 20
    assert sorted(lines_of(spark, str(tmp_path), n_bytes, False), key=repr) == sorted(want, key=repr)


def test_one_commit_is_read_by_several_tasks(spark, tmp_path):
    files = "".join(f"diff --git a/f{k} b/f{k}\n@@ -0,0 +1,400 @@\n" + "".join(f"+line {k} {i}\n" for i in range(400)) for k in range(20))
    put(tmp_path, "big.log", f"COMMIT:h|s|a|d|initial\n\n{files}COMMIT:h2|s2|a|d|next\n\ndiff --git a/z b/z\n@@ -0,0 +3 @@\n+end\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = gitlog.read_git_lines(spark, str(tmp_path))
        rows = log_walk.added_lines(lines)
        counts = lines.groupBy(F.spark_partition_id()).count().collect()
        assert len(counts) > 20 and max(r["count"] for r in counts) < 1000
        got = rows.orderBy("commit_order", "file_no", "line_number").collect()
        heads = log_walk.commit_headers(lines)
        assert [r.hash for r in heads.orderBy("commit_order").collect()] == ["h", "h2"]
        newest = log_walk.latest_lines(rows, gitlog.latest_commits(heads, 1))
        assert newest.count() == 8000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.hash, r.path, r.line_number, r.line) for r in got] == [("h", f"f{k}", i + 1, f"line {k} {i}") for k in range(20) for i in range(400)] + [("h2", "z", 3, "end")]


def test_dumps_in_parts(spark, tmp_path):
    """Written by many tasks, read back as one dump per repository; odd names come back."""
    names = ["a b/ü%2F", "007", "x=y+z"]
    rows = [(names[i % 3], i, f"h{i}|s{i}|a|d|m\ndiff --git a/f b/f\n@@ -0,0 +{i} @@\n+line {i}") for i in range(300)]
    path = str(tmp_path / "dumps")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gitlog.write_git_dumps(spark.createDataFrame([*rows, (None, 1, "x"), ("a", 2, None)], "repo string, n long, record string"), path, "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = gitlog.read_git_lines(spark, path)
    assert lines.select("part").distinct().count() > 3
    got = log_walk.added_lines(lines).orderBy("repo", "commit_order").collect()
    assert [(r.repo, r.hash, r.line_number) for r in got] == sorted(((repo, f"h{i}", i) for repo, i, _ in rows), key=lambda x: (x[0].encode(), x[2]))


def test_history_from_a_dump(spark, tmp_path):
    secret = 'token = "' + "0f" * 20 + '"'
    text = "".join(f"COMMIT:h{i}|s{i}|a|d|m\ndiff --git a/f b/{p}\n@@ -0,0 +{i} @@\n+{secret}\n" for i, p in [(1, "a.py"), (2, "a.py"), (3, "b.py"), (4, "x.lock"), (5, "dummy_1.py")])
    put(tmp_path, "r.log", text)
    lines = log_walk.added_lines(gitlog.read_git_lines(spark, str(tmp_path)))
    found = history.history_scan(lines, rules.builtin_secret_patterns(spark)).orderBy("file_path").collect()
    assert [(f.file_path, f.line_number, f.metadata["commit_short"]) for f in found] == [("a.py", 1, "s1"), ("b.py", 3, "s3")]


def test_nothing(spark, tmp_path):
    put(tmp_path, "empty.log", "")
    put(tmp_path, "junk.log", "+no commit\n@@ +1 @@\ndiff --git a/x b/x\n+still none\n")
    lines = gitlog.read_git_lines(spark, str(tmp_path))
    assert log_walk.added_lines(lines).count() == 0
    assert log_walk.commit_headers(lines).count() == 0
