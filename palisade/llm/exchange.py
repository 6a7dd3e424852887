"""Documents as compressed chunks, and questions about their words that travel by hash and come back as answers.

A map task can't ask a distributed table about each of its words without sending every word with a row of its own.
Here a chunk of documents sends one packed array to each hash bucket; the bucket answers each array in its order, so an
answer needs neither the words nor their places. The chunk is read again and lines the answers up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices, stored, utf8

CHUNKS = "chunk string, words long, blob binary"


def chunked(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """Stored rows (chunk, words, blob): about `chunk_bytes` of text in each, compressed; a longer text has a chunk
    of its own. A null text is empty. Nothing is shuffled."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            ids = pa.array([i for x in held for i in x[0]], pa.int64())
            texts = [t for x in held for t in x[1]]
            sink = pa.BufferOutputStream()
            table = pa.record_batch([ids, pa.array(texts, pa.large_binary())], ["id", "text"])
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_batch(table)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            words = sum(len(t) // 6 + 1 for t in texts)
            return pa.record_batch([[f"{part}-{n}"], [words], pa.array([blob], pa.binary())], ["chunk", "words", "blob"])

        for batch in slices(batches, "t", chunk_bytes):
            texts = utf8(batch.column("t"))
            here = sum(map(len, texts))
            if held and size + here > chunk_bytes:
                yield out()
                n, held, size = n + 1, [], 0
            held.append((batch.column("i").to_pylist(), texts))
            size += here
        if held:
            yield out()

    return stored(docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(make, CHUNKS))


def opened(blob: bytes) -> tuple[list[int | None], list[bytes]]:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as reader:
        table = reader.read_all()
    return table["id"].to_pylist(), table["text"].to_pylist()


def bucket_count(chunks: DataFrame, words_each: int) -> int:
    """So many buckets that each gets about `words_each` words: what a bucket holds doesn't grow with the input."""
    words = chunks.agg(F.sum("words")).first()[0] or 0
    return max(1, -(-words // words_each))


ASKED = "bucket long, chunk string, blob binary"


def asked(chunks: DataFrame, ask: Callable[[list, list], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows (bucket, chunk, blob): `ask(ids, texts)` gives the packed array for each bucket."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                yield questions(name, ask(*opened(blob)))

    return chunks.select("chunk", "blob").mapInArrow(make, ASKED)


def questions(chunk: str, found: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.string()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "chunk", "blob"])


def answered(questions_: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Rows (bucket, chunk, blob): `answer(blobs)` of one bucket gives a blob for each of its chunks."""

    def make(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "blob": pa.array(answer(table["blob"].to_pylist()), pa.binary())})

    return questions_.groupBy("bucket").applyInArrow(make, ASKED)


def rejoined(chunks: DataFrame, answers: DataFrame, work: Callable[[str, list, list, list[dict[int, bytes]]], pa.Table], schema: str, kinds: int = 1) -> DataFrame:
    """`work(chunk, ids, texts, answers by kind)` with `answers` (kind, bucket, chunk, blob) of that chunk."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[dict[int, bytes]] = [{} for _ in range(kinds)]
        for k, b, x in zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["blob"].to_pylist(), strict=True):
            found[k][b] = x
        ids, texts = opened(left["blob"][0].as_py())
        return work(left["chunk"][0].as_py(), ids, texts, found)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return chunks.select("chunk", "blob").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: make(a, b) if a.num_rows else empty, schema)


def bits(marks: np.ndarray) -> bytes:
    return len(marks).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.packbits(marks).tobytes())


def unbits(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8), count=n).astype(bool)
