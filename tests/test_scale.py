"""Plans and skew: what must hold on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from palisade.operators import findings as stored
from palisade.operators import dashboard, intel, remediate
from palisade.sources import exports
from palisade.streaming import progress

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n in QUERIES if not n.startswith("stream_") and n not in ("requirements_includes", "dependencies")]


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["dedupe_findings", "history_scan", "top_risks", "kev_feed", "sarif_rules", "corpus_findings"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(QUERIES[name](spark, SF_DIR)))


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["scan_risk"](spark, SF_DIR))
    assert "l_shipdate" not in text and "l_extendedprice" not in text


def test_filters_reach_the_scan(spark):
    assert "GreaterThanOrEqual(p_size,45)" in plan(QUERIES["enrich_cves"](spark, SF_DIR))


def test_text_detectors_do_not_shuffle(spark):
    from checks.queries.detection import demo_rules
    from checks.registry import Inputs
    from palisade.operators.detect import scan_files
    from palisade.sources.rules import builtin_baselines, builtin_secret_patterns

    t = Inputs(spark, SF_DIR)
    text = plan(scan_files(t.v_files, demo_rules(t), builtin_secret_patterns(spark), builtin_baselines(spark)))
    assert "Exchange" not in text and text.count("FileScan") == 1


def skewed(spark, n=30000):
    """A third of the rows in one scan, a third copies of one finding."""
    scan = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "copies").otherwise(F.concat(F.lit("s"), F.col("id") % 500))
    return spark.range(0, n, 1, 12).select(
        F.format_string("f%08d", "id").alias("finding_id"), scan.alias("scan_id"),
        F.when(F.col("id") % 3 == 1, "R").otherwise(F.concat(F.lit("R"), F.col("id") % 20)).alias("rule_id"),
        F.when(F.col("id") % 3 == 1, "f").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("file_path"),
        F.lit(1).alias("line_number"), F.lit("e").alias("evidence"), F.lit("T").alias("title"), F.lit("D").alias("description"),
        F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), (F.col("id") % 5 + 1).cast("int")).alias("severity"),
        F.lit("cve").alias("category"), F.lit("").alias("remediation"), F.lit(False).alias("is_fixed"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("CVE-2020-"), F.lpad((F.col("id") % 7).cast("string"), 4, "0"))).alias("cve_id"),
        F.lit(5.0).alias("cvss_score"),
    )


def test_copies_and_hot_scan(spark):
    found = skewed(spark)
    once = stored.dedupe_findings(found, ["finding_id"])
    counts = {r.scan_id: r["count"] for r in once.filter("scan_id in ('hot', 'copies')").groupBy("scan_id").count().collect()}
    assert counts == {"hot": 10000, "copies": 1} and once.count() == 20001
    first = once.filter("scan_id = 'copies'").first()
    assert first.finding_id == "f00000001"


def test_whole_results_under_skew(spark):
    found = skewed(spark)
    scans = found.select("scan_id").distinct().select(
        "scan_id", F.lit("/t").alias("target"), F.lit("completed").alias("status"), F.lit("full").alias("scan_type")
    )
    lines = exports.to_sarif(found, scans, ["finding_id"])
    assert lines.filter("section = 3").count() == 30000
    kev = spark.createDataFrame([], "cve_id string, product string, short_description string")
    epss = spark.createDataFrame([], "cve_id string, epss double, percentile double")
    records = intel.enrich_cves(found.select("cve_id"), kev, epss)
    top = dashboard.top_risks(found, records)
    assert top.filter("scan_id = 'hot'").count() == 5
    assert stored.scan_rollup(scans, found).agg(F.sum("total_findings")).first()[0] == 30000


def test_running_numbers_of_a_hot_scan(spark):
    events = spark.range(20000).select(
        F.col("id").alias("event_id"), F.lit("hot").alias("scan_id"), F.lit("finding_discovered").alias("type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 61).alias("ts"), F.lit("high").alias("severity"),
    )
    got = progress.running_count_history(events)
    assert got.filter(F.col("n") != F.col("event_id") + 1).count() == 0
    assert progress.idle_periods(events).count() == 0


def test_many_fixes_in_one_file(spark):
    content = "\n".join(f"k{i} = 1" for i in range(3000)) + "\n"
    table = spark.createDataFrame([("s", "a.py", content)], "scan_id string, path string, content string")
    found = spark.range(6000).select(
        F.format_string("f%05d", "id").alias("finding_id"), F.lit("s").alias("scan_id"), F.lit("S").alias("rule_id"),
        F.lit("secret").alias("category"), F.lit("a.py").alias("file_path"), (F.col("id") % 3000 + 1).cast("int").alias("line_number"),
        F.lit("").alias("evidence"), F.lit(None).cast("string").alias("cve_id"), F.lit(False).alias("is_fixed"),
    )
    changed, ids = remediate.apply_fixes(table, found, ["finding_id"])
    text = changed.first().content
    assert text.count("environ.get") == 3000 and text.endswith("\n") and ids.count() == 6000


def moved(spark, df, column):
    """Shuffles of the last plan that carry the column, each counted once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [x for x in re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*\)?[^)]*)\)[^\n]*\n[^\n]*Project \[([^\n]*)", text) if f"{column}#" in x[1] and "_json#" not in x[1]]


def test_findings_are_moved_once_for_their_place_in_a_report(spark):
    rows = spark.range(2000).select(
        F.format_string("f%05d", "id").alias("finding_id"), (F.col("id") % 50).cast("string").alias("scan_id"), F.concat(F.lit("wide "), F.col("id").cast("string")).alias("evidence")
    )
    lines = exports.array_lines(rows, 1, F.col("finding_id"), F.to_json(F.struct("finding_id", "evidence")))
    assert len(moved(spark, lines, "evidence")) == 1
    assert lines.filter("line not like ',%'").count() == 50


def test_sarif_findings_are_moved_once(spark):
    rows = spark.range(2000).selectExpr(
        "format_string('f%05d', id) AS finding_id", "string(id % 50) AS scan_id", "concat('R', id % 7) AS rule_id", "'t' AS title", "'sast' AS category", "'low' AS severity", "'a.py' AS file_path",
        "int(id % 9) AS line_number", "concat('wide ', id) AS evidence", "'d' AS description", "'' AS remediation",
    )
    lines = exports.to_sarif(rows, rows.select("scan_id").distinct(), ["finding_id"]).filter("section = 3")
    assert len(moved(spark, lines, "evidence")) == 1
    assert lines.filter("line not like ',%'").count() == 50


def test_tables_with_rows_in_enough_splits_are_not_dealt_again(spark, tmp_path):
    from checks.registry import Inputs

    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 40000 * cores, 1, 1).selectExpr("id AS c_custkey", "sha2(string(id), 512) AS c_name").write.option("parquet.block.size", 1 << 18).option("compression", "none").parquet(str(tmp_path / "customer.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        assert "RoundRobinPartitioning" not in plan(Inputs(spark, str(tmp_path)).busy.customer)
        assert "RoundRobinPartitioning" in plan(Inputs(spark, SF_DIR).busy.lineitem)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
