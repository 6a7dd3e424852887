"""Helpers of the corpus operators: stored intermediate tables, ranks, byte words, packed arrays."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import checkpoint_dir

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte as it is.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=8)
def _remove_at_exit(folder: str) -> None:
    def remove() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            delete(spark, folder)

    atexit.register(remove)


def work_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors share; removed when the
    driver ends. Only a local session may leave that setting out."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/palisade-{spark.sparkContext.applicationId}"
    _remove_at_exit(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stored:
    """A table written below the work folder: cuts the lineage, and an executor that is lost takes nothing along."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = f"{work_folder(self.spark)}/{uuid.uuid4().hex}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, *order: Column | str) -> DataFrame:
    """`df` with `rank`, from 0 in the given order. The rows are range-partitioned, so no task sees them all; only
    the row count of each partition comes to the driver."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("rank_key", F.monotonically_increasing_id()))
    part = F.shiftright("rank_key", 33)
    offsets, total = [], 0
    for row in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((row.p, total))
        total += row["count"]
    table = spark.createDataFrame(offsets or [(0, 0)], "rank_part long, rank_start long")
    within = F.col("rank_key").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.join(F.broadcast(table), part == F.col("rank_part"))  # a row for each partition
    return joined.withColumn("rank", F.col("rank_start") + within).drop("rank_key", "rank_part", "rank_start")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `most` bytes of text (one row at least)."""
    for batch in batches:
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), float))
        start, held = 0, 0.0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0.0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack(array: np.ndarray) -> bytes:
    """An array as compressed byte planes: sorted differences and small numbers leave empty planes."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T if len(array) else array
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads a change of any bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Bucket and place of each run of equal numbers in a sorted array."""
    if len(buckets):
        edges = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1))
        for a, b in zip(edges, [*edges[1:], len(buckets)], strict=True):
            yield int(buckets[a]), slice(a, b)
