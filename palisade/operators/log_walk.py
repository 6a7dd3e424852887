"""Added lines of `git log -p` dumps, line by line: commits, files of commits and hunks may be of any size.

What a line belongs to is said above it: commit, file, start of the hunk, lines since. A task walks through the lines
of its split and knows all this from the first header, file or hunk on; what comes before is marked as open. Each split
also gives a summary of its end, one row. Summaries are carried forward in the order of the log, and open places are
filled from what is carried into their split. So the lines themselves are not shuffled to be numbered, and nothing
holds more than a batch of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLIT = ["repo", "part", "block"]
HEADER = "COMMIT:"
FILE = re.compile(r"^diff --git.*? b/(.*)$")
HUNK = re.compile(r"\+([0-9]+)")
PARTS = ["hash", "short_hash", "author", "date", "message"]
MOST = 2**31 - 1


@dataclass
class Place:
    """What the next line of a split belongs to. Counts go on from the split's start until the first mark."""

    row: int = 0
    commit: int | None = None  # row of the header
    header: str | None = None
    files: int = 0
    marked: bool = False  # a header or a file line has been seen, so `path` is known (None: in no file)
    path: str | None = None
    started: bool = False  # a hunk, too, so `start` is known (None: not a number)
    start: int | None = 0
    count: int = 0

    def pass_mark(self, line: str, row: int) -> None:
        if line.startswith(HEADER):
            self.commit, self.header, self.files, self.path = row, line[len(HEADER):], 0, None
            self.marked, self.started, self.start, self.count = True, True, 0, 0
        elif line.startswith("diff"):
            self.files, self.path = self.files + 1, FILE.match(line).group(1)
            self.marked, self.started, self.start, self.count = True, True, 0, 0
        else:
            start = int(HUNK.search(line).group(1))
            self.started, self.start, self.count = True, start - 1 if start <= MOST else None, 0


def _masks(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks (headers, file lines, hunk lines with a start), lines that count, and those of them that were added."""

    def starts(text: str) -> np.ndarray:
        return pc.starts_with(lines, text).to_numpy(zero_copy_only=False)

    def only(rows: np.ndarray, pattern: re.Pattern) -> np.ndarray:
        out = np.zeros(len(lines), bool)
        for k in np.flatnonzero(rows):
            out[k] = pattern.search(lines[int(k)].as_py()) is not None
        return out

    file, hunk = starts("diff --git"), starts("@@")
    marks = starts(HEADER) | only(file, FILE) | only(hunk, HUNK)
    counted = ~(marks | file | hunk | starts("-"))
    return marks, counted, counted & starts("+") & ~starts("+++")


LINES = "repo string, part string, block long, commit long, header string, file_no int, marked boolean, path string, started boolean, line_number int, line string"
ENDS = "repo string, part string, block long, commit long, header string, files int, marked boolean, path string, started boolean, start int, count long"
HEADERS = "repo string, part string, block long, commit long, header string"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Place, pa.RecordBatch | None, list]]:
    """For each run of lines of one split: the split, the place behind the run, the run, and its segments (first line,
    place there). A last call for each split has no run."""
    split, place = None, Place()
    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in SPLIT), strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            if keys[at] == keys[-1]:
                end = len(keys)
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != split:
                if split is not None:
                    yield split, place, None, []
                split, place = keys[at], Place()
            run = batch.slice(at, end - at)
            lines = run.column("line")
            marks, counted, _ = _masks(lines)
            before = np.concatenate([[0], np.cumsum(counted)])
            segments, since = [(0, Place(**vars(place)))], 0
            for k in map(int, np.flatnonzero(marks)):
                place.count += int(before[k] - before[since])
                place.pass_mark(lines[k].as_py(), place.row + k)
                segments.append((k, Place(**vars(place))))
                since = k
            place.count += int(before[-1] - before[since])
            place.row += run.num_rows
            yield split, place, run, segments
            at = end
    if split is not None:
        yield split, place, None, []


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for split, _, run, segments in _walk(batches):
        if run is None:
            continue
        lines = run.column("line")
        _, counted, added = _masks(lines)
        before = np.cumsum(counted)
        rows = np.flatnonzero(added)
        firsts = np.array([k for k, _ in segments])
        own = np.searchsorted(firsts, rows, "right") - 1
        places = [p for _, p in segments]
        in_file = np.array([not p.marked or p.path is not None for p in places])
        rows, own = rows[in_file[own]], own[in_file[own]]
        # lines that count before the segment
        base = np.array([before[k - 1] if k else 0 for k in firsts], np.int64)
        number = np.array([(p.start or 0) + p.count for p in places], np.int64)[own] + before[rows] - base[own]
        lost = np.array([p.started and p.start is None for p in places], bool)[own] | (number > MOST)
        n = len(rows)

        def each(name: str, kind: pa.DataType, places=places, own=own) -> pa.Array:
            return pa.array([getattr(p, name) for p in places], kind).take(pa.array(own))

        yield pa.record_batch(
            [
                *(pa.array([v] * n, t) for v, t in zip(split, (pa.string(), pa.string(), pa.int64()), strict=True)),
                each("commit", pa.int64()), each("header", pa.string()), each("files", pa.int32()), each("marked", pa.bool_()), each("path", pa.string()), each("started", pa.bool_()),
                pa.array(np.where(lost, 0, number), pa.int32(), mask=lost),
                pc.utf8_slice_codeunits(lines.take(pa.array(rows)), 1),
            ],
            [c.split()[0] for c in LINES.split(", ")],
        )


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ENDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.int32(), pa.int64()]
    for split, place, run, _ in _walk(batches):
        if run is None:
            values = [*split, *(getattr(place, n) for n in names[3:])]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for split, _, run, segments in _walk(batches):
        if run is not None:
            found = [(*split, p.commit, p.header) for k, p in segments[1:] if run.column("line")[k].as_py().startswith(HEADER)]
            yield pa.record_batch([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], [c.split()[0] for c in HEADERS.split(", ")])


def _commit(df: DataFrame, *kept: str) -> DataFrame:
    """Header fields for rows with `header`, `of_part`, `of_block`, `commit`; headers with fewer parts end a commit only."""
    parts = F.split("header", r"\|", 5)
    order = F.struct(F.col("of_part").alias("part"), F.col("of_block").alias("block"), F.col("commit").alias("row"))
    fields = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(PARTS)]
    return df.filter(F.size(parts) >= 5).select("repo", order.alias("commit_order"), *fields, *kept)


def commit_headers(lines: DataFrame) -> DataFrame:
    """repo, commit_order, hash, short_hash, author, date, message: the commits of the lines (`sources.read_git_lines`)."""
    found = lines.mapInArrow(_headers, HEADERS)
    return _commit(found.withColumnsRenamed({"part": "of_part", "block": "of_block"}))


def carried(lines: DataFrame) -> DataFrame:
    """What is carried into each split from those before it in the dump: repo, part, block, c_header (header and where
    it is), c_files, c_path (path, null in no file), c_start, c_count. One row per split, so one per 128 MB or so."""
    ends = lines.mapInArrow(_ends, ENDS)
    in_order = W.partitionBy("repo").orderBy("part", "block")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)

    def last(value, known):
        return F.last(F.when(known, value), ignorenulls=True).over(before)

    def since(count: str, known):
        """What was counted since the last split in which the count began anew, that one's end included."""
        until = F.coalesce(F.sum(count).over(before), F.lit(0))
        return until - F.coalesce(F.last(F.when(known, F.col(f"_{count}")), ignorenulls=True).over(before), F.lit(0))

    with_sums = ends.select(
        "*", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in ("files", "count"))
    )
    begun = F.col("header").isNotNull()
    return with_sums.select(
        *SPLIT,
        last(F.struct("part", "block", "commit", "header"), begun).alias("c_header"),
        since("files", begun).alias("c_files"),
        last(F.struct("path"), F.col("marked")).alias("c_path"),
        last(F.struct("start"), F.col("started")).alias("c_start"),
        since("count", F.col("started")).alias("c_count"),
    )


def added_lines(lines: DataFrame) -> DataFrame:
    """repo, commit_order, hash, short_hash, author, date, message, file_no, path, line_number, line: added lines,
    numbered as in the new file.

    Removed lines do not count. A number above 2^31 - 1 is null. Lines before the first header, of a commit whose
    header has fewer than five parts, or outside a file are left out.
    """
    found = lines.mapInArrow(_added, LINES).withColumnsRenamed({c: f"l_{c}" for c in SPLIT})
    carry = carried(lines)
    joined = found.join(carry, [F.col(f"l_{c}").eqNullSafe(F.col(c)) for c in SPLIT], "left")
    open_commit = F.col("header").isNull()
    from_carry = F.struct(F.col("l_part").alias("part"), F.col("l_block").alias("block"), "commit", "header")
    of = F.when(open_commit, F.col("c_header")).otherwise(from_carry)
    path = F.when(F.col("marked"), F.col("path")).otherwise(F.col("c_path.path"))
    file_no = F.col("file_no") + F.when(open_commit, F.col("c_files")).otherwise(0)
    number = F.col("line_number") + F.when(F.col("started"), 0).otherwise(F.col("c_start.start") + F.col("c_count"))
    filled = joined.select(
        F.col("l_repo").alias("repo"), of.alias("of"), path.alias("path"), file_no.cast("int").alias("file_no"), number.cast("long").alias("number"), "line"
    ).filter("path is not null and of.header is not null")
    flat = filled.select("*", F.col("of.part").alias("of_part"), F.col("of.block").alias("of_block"), "of.commit", "of.header")
    line_number = F.when(F.col("number") <= MOST, F.col("number")).cast("int").alias("line_number")
    return _commit(flat, "file_no", "path", line_number, "line")


def latest_lines(lines: DataFrame, commits: DataFrame) -> DataFrame:
    """Of `added_lines` those of the commits up to the last of `commits` (see `latest_commits`) in each repository."""
    ends = commits.groupBy("repo").agg(F.max("commit_order").alias("_end"))
    return lines.join(ends, "repo").filter(F.col("commit_order") <= F.col("_end")).drop("_end")
