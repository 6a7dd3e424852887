"""Incremental scans over several deliveries: each finding once, and a batch meets only its own ids."""

import pytest

from palisade.operators import detect
from palisade.sources import rules
from palisade.streaming import ingest

TOKEN = 'token = "' + "0f" * 20 + '"\n'


def deliver(root, day, n=20):
    for k in range(n):
        path = root / f"s{k % 3}" / f"day{day}" / f"f{k}.py"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x\n" * k + TOKEN)


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("incremental")
    root, out = folder / "in", str(folder / "out")
    patterns = rules.builtin_secret_patterns(spark)
    runs = []

    def scan(checkpoint):
        progress = ingest.incremental_scan(spark, str(root), out, str(folder / checkpoint), lambda files: detect.secret_scan(files, patterns))
        runs.append((progress, ingest.ingested(spark, out).count() if progress else 0))

    for day in range(5):
        deliver(root, day)
        scan("first")
    scan("first")  # nothing new
    scan("second")  # all files again
    return runs, ingest.ingested(spark, out)


def test_each_finding_once(history):
    runs, stored = history
    assert [n for _, n in runs[:5]] == [20, 40, 60, 80, 100]
    assert runs[6][1] == 100
    rows = stored.collect()
    assert len({r.finding_id for r in rows}) == len(rows) == 100


def test_a_batch_reads_only_its_own(history):
    """Rows that come into the second stream, and state rows touched, are those of the delivery."""
    runs, _ = history
    for progress, _ in runs[:5]:
        assert sum(p.numInputRows for p in progress) == 20
        assert sum(s.numRowsUpdated for p in progress for s in p.stateOperators) == 20
    assert sum(p.numInputRows for p in runs[5][0]) == 0
    assert sum(s.numRowsUpdated for p in runs[6][0] for s in p.stateOperators) == 0


def test_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ingest.incremental_scan(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), lambda files: detect.secret_scan(files, rules.builtin_secret_patterns(spark))) == []
