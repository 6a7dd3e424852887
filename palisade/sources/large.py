"""Files that do not fit into a row, as chunks of lines.

The text reader splits a file of any size among tasks. Each task gathers its lines into chunks; a chunk also carries
some lines from before and behind, so that what stands around a line or goes on over several lines is seen whole. How
many lines precede a split, and which lines surround it, comes from one row per split: a prefix sum over the blocks of a
file. The lines themselves are not shuffled for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.sources.corpus import MAX_BYTES, placed_path

CHUNK_BYTES, MARGIN = 8 << 20, 50
SPLIT = ["file", "block"]
CHUNK = "file string, block long, size_bytes long, chunk int, before long, n_lines int, lead array<string>, own array<string>, trail array<string>, opens boolean, closes boolean"
ENDS = "file string, block long, lines long, head array<string>, tail array<string>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int] | None, pa.Array | None]]:
    """(file, block, size) and lines, run by run; (None, None) after the last run of each split."""
    split = None
    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in (*SPLIT, "size_bytes")), strict=True))
        at = 0
        while at < len(keys):
            end = len(keys) if keys[at] == keys[-1] else at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if split is not None and keys[at] != split:
                yield None, None
            split = keys[at]
            yield split, batch.column("line").slice(at, end - at)
            at = end
    if split is not None:
        yield None, None


def _chunks(chunk_bytes: int, margin: int):
    """Chunks of a split: as many lines as have about `chunk_bytes`, sent off when `margin` more lines are known."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        texts = pa.list_(pa.string())
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), texts, texts, texts, pa.bool_(), pa.bool_()]
        split, lead, lines, size, own, number, before = None, [], [], 0, None, 0, 0

        def chunk(n_own: int, closes: bool) -> pa.RecordBatch:
            values = [*split, number, before, n_own, lead, lines[:n_own], lines[n_own : n_own + margin], number == 0, closes]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        for key, run in _runs(batches):
            if key is None:
                while own is not None and own < len(lines):  # lines that were waiting as margin
                    yield chunk(own, False)
                    lead, lines, before, number = [*lead, *lines[:own]][-margin:] if margin else [], lines[own:], before + own, number + 1
                    own = None
                yield chunk(len(lines), True)
                split, lead, lines, size, own, number, before = None, [], [], 0, None, 0, 0
                continue
            split = key
            lengths = pc.binary_length(run).to_pylist()
            for text, length in zip(run.to_pylist(), lengths, strict=True):
                lines.append(text)
                size += length + 1
                if own is None and size >= chunk_bytes:
                    own = len(lines)
                if own is not None and len(lines) - own >= margin + 1:  # one more line: the split goes on behind the margin
                    yield chunk(own, False)
                    lead = [*lead, *lines[:own]][-margin:] if margin else []
                    lines, before, number = lines[own:], before + own, number + 1
                    size = sum(map(len, lines)) + len(lines)
                    own = None

    return work


def _ends(margin: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n, head, tail = None, 0, [], []
        for key, run in _runs(batches):
            if key is None:
                texts = pa.list_(pa.string())
                values, kinds = [split[0], split[1], n, head, tail], [pa.string(), pa.int64(), pa.int64(), texts, texts]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in ENDS.split(", ")])
                split, n, head, tail = None, 0, [], []
                continue
            split = key
            if len(head) < margin:
                head += run.slice(0, margin - len(head)).to_pylist()
            tail = [*tail, *run.slice(max(0, len(run) - margin)).to_pylist()][-margin:] if margin else []
            n += len(run)

    return work


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks for each core, not by a task for each folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _never_split(spark: SparkSession) -> int:
    """Bytes up to which the reader gives a file as one split, whatever else is read and on however many cores."""
    conf = spark._jsparkSession.sessionState().conf()
    return min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def read_chunks(
    spark: SparkSession, root: str, scan_id: str | None = None, glob: str | None = None,
    above: int = MAX_BYTES, chunk_bytes: int = CHUNK_BYTES, margin: int = MARGIN,
) -> DataFrame:
    """Files below `root` with more than `above` bytes: scan_id, path, relative_path, size_bytes, content, first_line,
    n_lead, n_lines.

    A row is a chunk: `n_lead` lines from before it, its own `n_lines` lines, the first of which is line `first_line` of
    the file, and up to `margin` lines from behind. Names and ids as `corpus.read_corpus` gives them; only a single line
    has to fit into a row. Smaller files are left out while files are listed. The reader does not say whether the last
    line has an end: what a pattern says about the very end of a file may not hold for its last chunk.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    with _few_listing_tasks(spark):
        listed = reader.text(root)
    size = F.col("_metadata.file_size")
    whole = _never_split(spark)
    unsplit = F.when(F.col("_metadata.file_block_length") == size, F.col("_metadata.file_block_start")).otherwise(
        F.raise_error(F.lit("the size of splits was lowered after read_chunks")).cast("bigint")
    )

    def lines_of(wanted: Column, block: Column) -> DataFrame:
        return listed.filter(wanted).select(
            F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"),
            block.alias("block"),
            size.alias("size_bytes"),
            F.make_valid_utf8("value").alias("line"),
        )

    lines = lines_of(size > max(above, whole), F.col("_metadata.file_block_start"))
    ends = lines.mapInArrow(_ends(margin), ENDS)
    in_order = W.partitionBy("file").orderBy("block")
    near = max(margin, 1)  # so many splits have as many lines, if each has one
    joined = lambda column, frame: F.flatten(F.collect_list(column).over(frame))
    last = joined("tail", in_order.rowsBetween(-near, -1))
    around = ends.select(
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("lines").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"),
        F.slice(last, F.greatest(F.size(last) - margin + 1, F.lit(1)), F.lit(margin)).alias("_lead"),
        F.slice(joined("head", in_order.rowsBetween(1, near)), 1, margin).alias("_trail"),
    )
    chunks = lines.mapInArrow(_chunks(chunk_bytes, margin), CHUNK)
    rows = chunks.join(around, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).drop("_file", "_block")
    # nothing is before or behind the one split of a small file: its lines are read once and its chunks are not moved
    none = F.array().cast("array<string>")
    alone = {"_above": F.lit(0).cast("bigint"), "_lead": none, "_trail": none}
    small = lines_of((size > above) & (size <= whole), unsplit).mapInArrow(_chunks(chunk_bytes, margin), CHUNK).withColumns(alone)
    rows = small.unionByName(rows)
    # a chunk near an end of its split has fewer lines there than the margin: the rest comes from the next splits
    lead = F.concat("_lead", "lead")
    lead = F.slice(lead, F.greatest(F.size(lead) - margin + 1, F.lit(1)), F.lit(margin))
    trail = F.slice(F.concat("trail", F.when(F.col("closes") | (F.size("trail") < margin), F.col("_trail")).otherwise(F.array().cast("array<string>"))), 1, margin)
    placed = rows.withColumns({"lead": lead, "trail": trail})
    scan, path, relative = placed_path(F.col("file"), root, scan_id)
    return placed.select(
        scan.alias("scan_id"), path.alias("path"), relative.alias("relative_path"), "size_bytes",
        F.array_join(F.concat("lead", "own", "trail"), "\n").alias("content"),
        (F.col("_above") + F.col("before") + 1).alias("first_line"),
        F.size("lead").alias("n_lead"), "n_lines",
    )
