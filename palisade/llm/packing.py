"""Sequences of a fixed number of tokens, filled by best fit.

Documents become pieces (only those longer than a sequence are cut). Pieces of one length are alike to best fit, so
best fit works on the histogram of lengths, at most as many rows as a sequence has tokens: one loop on the driver goes
through the lengths, the longest first, and gives each the smallest gaps that hold it; where there is no gap, sequences
are opened. Spark ranks the pieces by a range sort over their lengths and places each by its rank. Bulk-synchronous
sweeps with conflicts are not needed for that, and there are none: a departure from the dealt method.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm.common import slices, stored, with_rank

#: Splits text before the merges of the rank file (fixed value of that vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """Texts to token ids as the tokenizer at `path` (.json) gives them without added tokens. The file of ranks beside
    it (.tiktoken), if there is one, holds the same merges and is read by a faster library; texts that hold the string
    of an added token go to the tokenizer itself."""
    slow = Tokenizer.from_file(path)
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks = path.removesuffix(".json") + ".tiktoken"

    def whole(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if not os.path.exists(ranks):
        return whole
    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in added):
            return whole(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, or pieces of `capacity` tokens behind a first
    piece with the rest."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, "t"):
            rows: list[tuple[int, int, int, int, int]] = []
            for row, value in enumerate(batch.column("t").to_pylist()):
                ids = np.append(encode(value or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                rows += [(row, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            row, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.record_batch([batch.column("i").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    out = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return out.mapInArrow(make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (first rank, sequence, offset) for runs of pieces: piece `rank` in the order by length goes to sequence +
    (rank - first rank). `counts`: pieces by length."""
    first, at = {}, 0
    for length in sorted(counts):
        first[length], at = at, at + counts[length]
    sizes: list[int] = []  # of gaps, sorted
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences (first, number)
    rows, opened = [], 0

    def free(size: int, run: tuple[int, int]) -> None:
        if size not in gaps:
            bisect.insort(sizes, size)
            gaps[size] = []
        gaps[size].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = first[length], counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)  # the successor gap
            if k == len(sizes):
                n = -(-left // (capacity // length))
                free(capacity, (opened, n))
                opened += n
                continue
            size = sizes[k]
            runs = gaps.pop(size)
            del sizes[k]
            for start, n in runs:
                won = min(n, left)
                if won:
                    rows.append((rank, start, capacity - size))
                    rank, left = rank + won, left - won
                    if size > length:
                        free(size - length, (start, won))
                if n > won:
                    free(size, (start + won, n - won))
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def pack_sequences(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all `docs` with `sequence_id` and `offset`; each sequence is filled from 0 without a hole.

    A null text is empty and gives a piece of the end token alone; repeated rows and ids are packed each; other columns
    of `docs` are not read; an empty table gives an empty one. The histogram of lengths (at most `capacity` rows) is all
    that the driver sees."""
    made = stored(pieces(docs, path, end_id, capacity, doc_id, text))
    plan = best_fit({r.length: r["count"] for r in made.groupBy("length").count().collect()}, capacity)
    ranked = with_rank(made, "length", "doc_id", "piece")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            run = plan[np.searchsorted(plan[:, 0], rank, "right") - 1]
            keep = [batch.column(n) for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*keep, pa.array(run[:, 1] + rank - run[:, 0]), pa.array(run[:, 2])], [n for n in batch.schema.names if n != "rank"] + ["sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
