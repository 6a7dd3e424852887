"""Pages by place and cursor, a filter before texts move, and scans in SQL."""

import pytest
from pyspark.sql import functions as F

from palisade.functions.sql import register_sql
from palisade.operators import pages
from palisade.operators.common import FILTER_WORDS, likely_among, source_lines
from palisade.sources import rules


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    rows = spark.range(5000).select(F.format_string("f%05d", "id").alias("finding_id"), F.timestamp_seconds(F.col("id") % 900).alias("created_at"), (F.col("id") % 7).alias("kind"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages.write_pages(rows, path, "finding_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, [r.finding_id for r in rows.orderBy(F.col("created_at").desc(), "finding_id").collect()]


@pytest.mark.parametrize(("page", "size"), [(1, 20), (2, 20), (125, 20), (250, 20), (251, 20), (3, 1000), (1, 9000), (71, 70), (72, 70)])
def test_page_by_number(spark, stored, page, size):
    path, ids = stored
    assert [r.finding_id for r in pages.read_page(spark, path, page, size).collect()] == ids[(page - 1) * size : page * size]


def test_a_deep_page_opens_its_place_only(spark, stored):
    plan = pages.read_page(spark, stored[0], 200, 20)._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters: ")[1].split("\n")[0]
    assert "GreaterThanOrEqual(_place" in pushed and "EqualTo(_part" in pushed


def test_pages_of_a_filter(spark, stored):
    path, ids = stored
    want = [x for x in ids if int(x[1:]) % 7 == 3]
    got, cursor, n = [], None, 0
    while True:
        page, cursor = pages.next_page(spark, path, F.col("kind") == 3, cursor, 130)
        got += [r.finding_id for r in page.collect()]
        n += 1
        if cursor is None:
            break
    assert got == want and n == -(-len(want) // 130)
    none, cursor = pages.next_page(spark, path, F.col("kind") == 99)
    assert none.count() == 0 and cursor is None


def test_filter_keeps_what_is_wanted(spark):
    files = spark.range(20_000).select((F.col("id") % 50).cast("string").alias("scan_id"), F.concat(F.lit("/f"), "id").alias("path"), F.lit("a\nb").alias("content"))
    wanted = files.filter("id % 97 = 0" if "id" in files.columns else "cast(substr(path, 3) as int) % 97 = 0").select("scan_id", "path")
    kept = likely_among(files, wanted, ["scan_id", "path"])
    assert kept.join(wanted, ["scan_id", "path"], "left_semi").count() == wanted.count()
    assert kept.count() < wanted.count() * 1.2 + 5 and kept.columns == files.columns
    assert likely_among(files, wanted.limit(0), ["scan_id", "path"]).count() == 0
    lines = source_lines(files, wanted.withColumn("line_number", F.lit(2)), 0)
    assert {r.lines[0].content for r in lines.collect()} == {"b"} and lines.count() == wanted.count()
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and FILTER_WORDS <= 1 << 16


def test_scans_in_sql(spark):
    files = spark.createDataFrame([("s1", "/a/x.py", 'token = "' + "0f" * 20 + '"'), ("s2", "/b/nginx.conf", "listen 80;\n4111111111111111")], "scan_id string, path string, content string")
    register_sql(spark, files, patterns=rules.builtin_secret_patterns(spark))
    rows = spark.sql("SELECT f.rule_id, length(p.content) > 10 AS long FROM findings_of('s1') f JOIN palisade_files p ON p.path = f.file_path").collect()
    assert [(r.rule_id, r.long) for r in rows] == [("SECRET-HEX-TOKEN", True)]
    assert spark.sql("SELECT scan_id FROM findings_below('/b/')").collect()[0].scan_id == "s2"
    above = spark.sql("SELECT category, count(*) AS n FROM findings_above('low') GROUP BY category").collect()
    assert [(r.category, r.n) for r in above] == [("secret", 2)]
    assert spark.sql("SELECT * FROM findings_of('none')").count() == 0
