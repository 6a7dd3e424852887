"""Streams that are fed in steps."""

import json

from palisade.operators import detect
from palisade.sources import rules as rule_source
from palisade.streaming import ingest, progress

EVENTS = "event_id long, ts timestamp, scan_id string, type string, percent double, severity string"


def test_read_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [
        {"event_id": 1, "ts": "2024-01-01T00:00:00", "scan_id": "a", "type": "progress", "percent": 10.0},
        {"event_id": 2, "ts": "2024-01-01T00:01:00", "scan_id": "a", "type": "scan_failed", "percent": 20.0},
        {"event_id": 3, "ts": "2024-01-01T00:02:00", "scan_id": "a", "type": "progress", "percent": 30.0},
        {"event_id": 4, "ts": "2024-01-01T00:00:00", "scan_id": "b", "type": "status_change"},
    ]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(e) for e in events))
    status = progress.latest_status(progress.read_progress(spark, str(tmp_path / "in")))
    q = (status.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / "out")))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.scan_id: (r.status, r.percent, r.n_events) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("failed", 20.0, 3), "b": ("running", None, 1)}


def test_idle_periods_across_units(spark):
    rows = [(i, t, "a", "progress", 0.0, "") for i, t in enumerate(
        ["2024-01-01 23:59:00", "2024-01-02 00:03:59", "2024-01-02 00:08:59", "2024-01-05 00:00:00", "2024-01-05 00:00:00"])]
    events = spark.createDataFrame(rows, "event_id long, ts string, scan_id string, type string, percent double, severity string")
    events = events.withColumn("ts", events.ts.cast("timestamp"))
    got = [(str(r.idle_from), str(r.idle_to)) for r in progress.idle_periods(events).orderBy("idle_from").collect()]
    assert got == [("2024-01-02 00:03:59", "2024-01-02 00:08:59"), ("2024-01-02 00:08:59", "2024-01-05 00:00:00")]
    assert progress.idle_periods(events, unit="hour").count() == 2
    assert [r.n for r in progress.sessions(events).orderBy("first_ts").collect()] == [2, 1, 2]


def test_dedupe_on_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"scan_id": "s", "rule_id": "r", "file_path": "f", "line_number": 1, "evidence": "e"}
    (folder / "1.json").write_text("\n".join(json.dumps({**row, "at": f"2024-01-01T00:0{i}:00"}) for i in range(3)))
    (folder / "2.json").write_text(json.dumps({**row, "at": "2024-01-01T00:05:00"}) + "\n" + json.dumps({**row, "line_number": 2, "at": "2024-01-01T00:05:00"}))
    source = spark.readStream.schema("scan_id string, rule_id string, file_path string, line_number int, evidence string, at timestamp").option(
        "maxFilesPerTrigger", 1).json(str(folder))
    q = (progress.stream_dedupe(source, "at", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.line_number for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_incremental_ingest(spark, tmp_path):
    root, out, cp = tmp_path / "corpus", str(tmp_path / "out"), str(tmp_path / "cp")
    (root / "scan1").mkdir(parents=True)
    (root / "scan2").mkdir()
    rules, patterns = rule_source.builtin_rules(spark), rule_source.builtin_secret_patterns(spark)

    def look(files):
        return detect.scan_files(files, rules, patterns)

    def run():
        q = ingest.incremental_ingest(spark, str(root), out, cp, look)
        q.awaitTermination()
        return spark.read.parquet(out)

    (root / "scan1" / "a.conf").write_text("debug = true\n")
    assert run().count() == 1
    assert run().count() == 1
    (root / "scan2" / "b.yml").write_text("x: 1\ndebug: on\n4111111111111111\n")
    (root / "scan1" / "c.conf").write_text("fine\n")
    stored = run()
    assert stored.count() == 3 and stored.select("finding_id").distinct().count() == 3
    assert {(r.scan_id, r.batch) for r in stored.collect()} == {("scan1", 0), ("scan2", 1)}
    rollup = {r.scan_id: r.total_findings for r in ingest.stored_rollup(spark, out).collect()}
    assert rollup == {"scan1": 1, "scan2": 2}


def test_replayed_batch_writes_the_same(spark, tmp_path):
    requests = spark.createDataFrame([("1", "2024-01-01 00:00:00")], "scan_id string, at string")
    requests = requests.withColumn("at", requests.at.cast("timestamp_ntz"))
    table = spark.createDataFrame([("1", "running"), ("2", "running"), ("3", "failed")], "scan_id string, status string")
    requests.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    for n in range(2):  # a new checkpoint replays batch 0 into the same folder
        progress.cancel_stream(source, table, str(tmp_path / "out"), str(tmp_path / f"cp{n}")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.scan_id, r.status, r.error) for r in got] == [("1", "failed", "Scan cancelled by user")]


def test_rollup_of_a_batch_does_not_sort_the_tables(spark):
    scans = spark.range(2000).selectExpr("CASE WHEN id = 7 THEN NULL ELSE CAST(id AS STRING) END AS scan_id", "'t' AS target")
    found = spark.range(9000).selectExpr("CASE WHEN id % 10 = 3 THEN NULL ELSE CAST(id % 3000 AS STRING) END AS scan_id", "'high' AS severity")
    done = spark.createDataFrame([("5",), ("5",), ("11",), (None,), ("2500",), ("13",)], "scan_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = progress.finished_rollup(scans, found)(done)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.scan_id, r.target, r.total_findings, r.high_count) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == [("11", "t", 3, 3), ("13", "t", 0, 0), ("5", "t", 3, 3)]
    # stored tables meet the bounded filter and then the ids in a hash join; only counters are sorted
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("ShuffledHashJoin") == 2 and plan.count("SortMergeJoin") == 1
