"""Scans of newly arrived files only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryProgress

from palisade.operators.findings import bucket_counts
from palisade.plans.scan import stored_findings
from palisade.session import remove, written
from palisade.sources.corpus import MAX_BYTES, corpus_rows

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in the checkpoint: the same after a restart, another with a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value)["id"]


def _stored_ids(rows: DataFrame, path: str, run: str, batch_id: int, buckets: int) -> DataFrame | None:
    """Ids that other batches wrote into the buckets of these rows, or None before the first batch."""
    spark = rows.sparkSession
    if not _exists(spark, path):
        return None
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
    other = ~((F.col("run") == run) & (F.col("batch") >= batch_id)) & F.col("bucket").isin(touched)
    schema = "finding_id string, run string, batch long, bucket int"
    return spark.read.schema(schema).parquet(path).filter(other).select("finding_id")


def incremental_ingest(
    spark: SparkSession,
    root: str,
    findings_path: str,
    checkpoint: str,
    detect: Callable[[DataFrame], DataFrame],
    files_per_trigger: int = 1000,
    buckets: int = 64,
) -> StreamingQuery:
    """Scan the files that arrived since the last run with `detect` (files to findings), then stop.

    Findings go to `findings_path/run=<id>/batch=<n>/bucket=<b>`, the bucket being a hash of the scan. A batch
    that is run again writes the same rows to the same folder, a new checkpoint writes to folders of its own, and a
    finding that another batch stored is not stored twice: ids are made from the content of a finding, and only the buckets that
    a batch touches are looked up.
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(root)
        .filter(F.col("length") <= MAX_BYTES)  # larger ones: sources.large
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        files = corpus_rows(batch, root)
        bucket = F.pmod(F.hash("scan_id"), F.lit(buckets))
        rows, path = written(stored_findings(detect(files)).withColumn("bucket", bucket))
        run = _run_id(spark, checkpoint)
        known = _stored_ids(rows, findings_path, run, batch_id, buckets)
        if known is not None:
            rows = rows.join(known, "finding_id", "left_anti")
        folder = f"{findings_path.rstrip('/')}/run={run}/batch={batch_id}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        remove(spark, path)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def incremental_scan(
    spark: SparkSession,
    root: str,
    findings_path: str,
    checkpoint: str,
    detect: Callable[[DataFrame], DataFrame],
    files_per_trigger: int = 1000,
    buckets: int = 64,
) -> list[StreamingQueryProgress]:
    """Scan the files that arrived since the last run and store each finding once, without reading what is stored.

    One stream turns files into findings below `findings_path/staged`, a folder for each batch, which a batch that is run
    again overwrites. A second one passes those on whose id it has not seen, to `findings_path/findings`. The ids are
    keyed state beside the findings, not in `checkpoint`: a batch looks up its own ids only, and a new checkpoint scans
    all files again but stores nothing twice. Gives the progress of the second stream; read with `ingested`.
    """
    base = findings_path.rstrip("/")
    stream = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(root)
        .filter(F.col("length") <= MAX_BYTES)  # larger ones: sources.large
    )

    def stage(batch: DataFrame, batch_id: int) -> None:
        rows = stored_findings(detect(corpus_rows(batch, root)))
        folder = f"{base}/staged/run={_run_id(spark, checkpoint)}/batch={batch_id}"
        rows.withColumn("bucket", F.pmod(F.hash("scan_id"), F.lit(buckets))).write.mode("overwrite").parquet(folder)

    stream.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, f"{base}/staged"):
        return []
    staged = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/staged")
    arrived = spark.readStream.schema(staged.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(f"{base}/staged")
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = (
            arrived.dropDuplicates(["finding_id"])
            .writeStream.format("parquet")
            .partitionBy("bucket")
            .option("path", f"{base}/findings")
            .option("checkpointLocation", f"{base}/seen")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return query.recentProgress


def ingested(spark: SparkSession, findings_path: str) -> DataFrame:
    """Findings that `incremental_scan` has stored."""
    return spark.read.parquet(f"{findings_path.rstrip('/')}/findings")


def stored_rollup(spark: SparkSession, findings_path: str) -> DataFrame:
    """Counters per scan over everything stored so far."""
    return spark.read.parquet(findings_path).groupBy("scan_id").agg(*bucket_counts())
