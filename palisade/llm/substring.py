"""Removal of passages that an earlier document has already.

Anchors: every document is cut into non-overlapping blocks of half a window; these are the index. Every rolling window
of that width, at every word of every document, probes it. A passage of a whole window that two documents share holds
a complete block of either, so no passage is missed. Blocks and probes meet by hash, packed by chunk (`exchange`); a
bucket answers one bit for each of a chunk's distinct probes: is it a block somewhere, and in more than one document?
Hits are then extended: each full window around a hit asks for the smallest document that has the same words, and the
windows that an earlier document has make up the maximal repeats that are cut out. No pair of documents is ever made,
so copies in any number cost as much as their words.

Words are compared by 64-bit hashes of all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import cuts, pack, stored, unpack
from palisade.llm.exchange import ASKED, answered, asked, bits, bucket_count, chunked, questions, rejoined, unbits
from palisade.llm.words import Layout, rolling

NO_ID = np.iinfo(np.int64).max
LOW = np.uint64(0xFFFFFFFF)


def _joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parted(blob: bytes) -> list[bytes]:
    out = []
    while blob:
        n = int.from_bytes(blob[:8], "little")
        out.append(blob[8 : 8 + n])
        blob = blob[8 + n :]
    return out


class _Runs:
    """Equal keys of an array, in the order of the keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys, kind="stable")
        keys = keys[self.order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.at = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        self.keys = keys[self.at]

    def fold(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        return how.reduceat(values[self.order], self.at) if len(self.at) else values[:0]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value for each run back to the places of its keys."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = values[self.run]
        return out


class _Chunk:
    def __init__(self, ids: list, texts: list[bytes], window: int, buckets: int) -> None:
        self.ids = np.array([NO_ID if x is None else x for x in ids], np.int64)
        self.layout, self.window, self.block, self.buckets = Layout(texts), window, window // 2, buckets
        self.grams = rolling(self.layout.hashes, self.block)
        self.probes = self.layout.fits(self.block)
        g = self.grams[self.probes]
        self.asked = _Runs((g % np.uint64(buckets) << np.uint64(32)) | (g >> np.uint64(32)))

    def probe(self) -> Iterator[tuple[int, bytes]]:
        doc = self.layout.doc[self.probes]
        block = (self.probes - self.layout.first[doc]) % self.block == 0
        several = self.asked.fold(np.minimum, doc) != self.asked.fold(np.maximum, doc)
        flags = (self.asked.fold(np.maximum, block.astype(np.uint8)) | several.astype(np.uint8) << 1).astype(np.uint8)
        hashes = (self.asked.keys & LOW).astype(np.uint32)
        for b, here in cuts((self.asked.keys >> np.uint64(32)).astype(np.int64)):
            yield b, _joined(pack(np.diff(hashes[here], prepend=np.uint32(0))), pack(flags[here]))

    def answers(self, keys: np.ndarray, found: dict[int, bytes]) -> np.ndarray:
        parts = [unbits(found[b]) for b, _ in cuts(keys)]
        return np.concatenate(parts) if parts else np.empty(0, bool)

    def extend(self, hit: dict[int, bytes]) -> None:
        """Full windows that hold a hit, and their distinct hashes with the smallest id in this chunk."""
        is_hit = np.zeros(self.layout.n + 1, np.int64)
        yes = self.asked.spread(self.answers((self.asked.keys >> np.uint64(32)).astype(np.int64), hit))
        is_hit[self.probes + 1] = yes
        before = np.cumsum(is_hit)
        at = self.layout.fits(self.window)
        self.at = at[before[at + self.window - self.block + 1] > before[at]]
        whole = rolling(self.layout.hashes, self.window)[self.at]
        bucket = (whole % np.uint64(self.buckets)).astype(np.int64)
        self.windows = _Runs(whole)
        self.least = self.windows.fold(np.minimum, self.ids[self.layout.doc[self.at]])
        self.bucket = self.windows.fold(np.minimum, bucket)
        self.dealt = np.argsort(self.bucket, kind="stable")

    def ask_windows(self) -> Iterator[tuple[int, bytes]]:
        keys, least = self.windows.keys[self.dealt], self.least[self.dealt]
        for b, here in cuts(self.bucket[self.dealt]):
            yield b, _joined(pack(keys[here]), pack(least[here]))

    def removed(self, found: dict[int, bytes]) -> np.ndarray:
        """For each word: is it in a window that starts in a document with a smaller id?"""
        elsewhere = np.empty(len(self.windows.keys), bool)
        elsewhere[self.dealt] = self.answers(self.bucket[self.dealt], found)
        own = self.ids[self.layout.doc[self.at]]
        late = self.windows.spread(elsewhere) | (own > self.windows.spread(self.least))
        step = np.zeros(self.layout.n + 1, np.int64)
        np.add.at(step, self.at[late], 1)
        np.add.at(step, self.at[late] + self.window, -1)
        return np.cumsum(step)[:-1] > 0


def _repeated(blobs: list[bytes]) -> list[bytes]:
    """Probes that are a block in some document and occur in more than one."""
    parts = [_parted(x) for x in blobs]
    hashes = [np.cumsum(unpack(a, "u4"), dtype=np.uint32) for a, _ in parts]
    flags = np.concatenate([unpack(b, "u1") for _, b in parts])
    runs = _Runs(np.concatenate(hashes))
    size = np.diff([*runs.at, len(flags)])
    either = runs.fold(np.bitwise_or, flags)
    yes = runs.spread((either & 1 > 0) & ((size > 1) | (either & 2 > 0)))
    ends = np.cumsum([len(h) for h in hashes])
    return [bits(x) for x in np.split(yes, ends[:-1])]


def _earlier(blobs: list[bytes]) -> list[bytes]:
    """Windows that a document with a smaller id than any of the chunk's has."""
    parts = [_parted(x) for x in blobs]
    keys, least = [unpack(a, "u8") for a, _ in parts], np.concatenate([unpack(b, "i8") for _, b in parts])
    runs = _Runs(np.concatenate(keys))
    yes = runs.spread(runs.fold(np.minimum, least)) < least
    ends = np.cumsum([len(k) for k in keys])
    return [bits(x) for x in np.split(yes, ends[:-1])]


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, chunk_bytes: int = 8 << 20, bucket_words: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each word that a window of `window` words covers whose words also start in
    a document with a smaller id is left out; `kept` are the other words, joined by one space.

    Windows are judged on the input. A null or empty text has no words and an empty `kept`; a text shorter than a
    window stays whole; rows with the same id cut nothing out of each other; a row without an id counts as the last
    of all (and keeps a null id); ids are integers; other columns of `docs` are not read; an empty table gives an empty one."""
    chunks = chunked(docs, doc_id, text, chunk_bytes)
    buckets = bucket_count(chunks, bucket_words)
    asks = asked(chunks, lambda ids, texts: _Chunk(ids, texts, window, buckets).probe())
    hits = answered(asks, _repeated).withColumn("kind", F.lit(0))

    def extend(chunk: str, ids: list, texts: list, found: list[dict[int, bytes]]) -> pa.Table:
        here = _Chunk(ids, texts, window, buckets)
        here.extend(found[0])
        return pa.Table.from_batches([questions(chunk, here.ask_windows())])

    def cut(chunk: str, ids: list, texts: list, found: list[dict[int, bytes]]) -> pa.Table:
        here = _Chunk(ids, texts, window, buckets)
        here.extend(found[0])
        gone = here.removed(found[1])
        kept, removed = [], []
        for t, a, b in zip(texts, here.layout.first, here.layout.last, strict=True):
            words, out = t.split(), gone[a:b]
            removed.append(int(out.sum()))
            kept.append(b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x) if removed[-1] else b" ".join(words))
        sizes = here.layout.last - here.layout.first
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(columns, ["doc_id", "n_words", "n_removed", "kept"])

    hits = stored(hits)
    late = answered(rejoined(chunks, hits, extend, ASKED), _earlier).withColumn("kind", F.lit(1))
    return rejoined(chunks, hits.unionByName(late), cut, "doc_id long, n_words long, n_removed long, kept string", 2)
