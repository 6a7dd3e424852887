"""Session settings and the one place that decides where intermediate tables go."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. They go on the session, so that a cluster can override any of them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # no call-site capture for every column expression: plans with many expressions build faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # session_window merges per map task before the shuffle, so that a busy scan is not one big group
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `extra` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="palisade-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only if it names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return "file://" + _local_folder()


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@lru_cache(maxsize=8)
def _removed_at_exit(folder: str) -> None:
    def clear() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            remove(spark, folder)

    atexit.register(clear)


def new_path(spark: SparkSession) -> str:
    """An unused path below the checkpoint folder, in a folder of this application that is removed when the driver ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/palisade-{spark.sparkContext.applicationId}"
    _removed_at_exit(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` as Parquet at a `new_path`, and the path. What is asked of it later reads only its own columns."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    return written(df)[0]
