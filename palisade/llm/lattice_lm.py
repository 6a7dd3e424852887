"""Probability of whole documents under a subword lattice.

The vocabulary is an existing one; its strings are weighted by what the distinct training words are made of (the
library segments each once), so that they say how a *new* word looks. A word's lattice holds all vocabulary strings
(characters without a string go through their bytes) and one arc more, the whole word, if training texts have it:
the counts, less a discount, weigh that arc, and what the discounts leave weighs the rest. The forward recursion in
log space sums over all segmentations. No vocabulary string goes on past a space, so a document is the product of its
words and its end.

Languages and topics share few words. So a document belongs to a class, which only its text decides: the commonest
word of the corpus that it has most often. Words of a class back off to all words, its strings to all strings.
A document's score has its class's probability as a factor, so it is one term of the sum over classes: the scores of
all possible texts add up to one at most.

Words are counted and scored once for each class: chunks of documents ask hash buckets about their distinct words
(`exchange`). Classes and vocabulary bound what comes to the driver; counts of words stay in their buckets.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log, log10
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ASCII_LOWER, cuts, pack, slices, stored, unpack, utf8
from palisade.llm.exchange import ASKED, CHUNKS, answered, bucket_count
from palisade.llm.exchange import questions as packed
from palisade.llm.token_counts import SPACE, processor

LN10 = log(10)
#: Words longer than this many characters go through the lattice one at a time.
WIDE = 48
#: A question's first byte is its class, counted from this letter.
FIRST_CLASS = 64


class Counted(NamedTuple):
    """The words of a chunk's texts, each text split and counted once: word `at[k]` of `words` comes `n[k]` times in text
    `doc[k]`, in the order of first places."""

    ids: list[int | None]
    train: np.ndarray
    words: list[bytes]
    doc: np.ndarray
    at: np.ndarray
    n: np.ndarray


COUNTED = pa.schema([("id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("words", pa.large_binary()), ("size", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def _counted_blob(ids: list, train: list[bool], texts: list[bytes]) -> bytes:
    place: dict[bytes, int] = {}
    sizes, at, n = [], [], []
    for text in texts:
        words = Counter(text.translate(ASCII_LOWER).split())
        sizes.append(len(words))
        at += [place.setdefault(w, len(place)) for w in words]
        n += words.values()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, COUNTED) as writer:
        writer.write_batch(pa.record_batch([[ids], [train], [b" ".join(place)], [sizes], [np.array(at, np.int32)], [np.array(n, np.int32)]], schema=COUNTED))
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _opened(blob: bytes) -> Counted:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as reader:
        row = reader.read_all()
    of = lambda name: row[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = of("size")
    words = row["words"][0].as_py()
    return Counted(row["id"][0].as_py(), of("train"), words.split(b" ") if words else [], np.repeat(np.arange(len(sizes)), sizes), of("at").astype(np.int64), of("n").astype(np.int64))


def counted(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Stored rows (chunk, words, blob) of `docs` (i, t, train): about `chunk_bytes` of text in each, a longer text has a
    chunk of its own. Nothing is shuffled."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, ([], [], []), 0

        def out() -> pa.RecordBatch:
            words = sum(len(t) // 6 + 1 for t in held[2])
            return pa.record_batch([[f"{part}-{n}"], [words], pa.array([_counted_blob(*held)], pa.binary())], ["chunk", "words", "blob"])

        for batch in slices(batches, "t", chunk_bytes):
            texts = utf8(batch.column("t"))
            here = sum(map(len, texts))
            if held[0] and size + here > chunk_bytes:
                yield out()
                n, held, size = n + 1, ([], [], []), 0
            for old, new in zip(held, (batch.column("i").to_pylist(), batch.column("train").to_pylist(), texts), strict=True):
                old += new
            size += here
        if held[0]:
            yield out()

    return stored(docs.select("i", "t", "train").mapInArrow(make, CHUNKS))


def _classes(c: Counted, anchors: dict[bytes, int]) -> np.ndarray:
    """Class of each text: the place of the anchor that it has most often, from 1; 0 without one."""
    kind, rank = np.zeros(len(c.ids), np.int64), np.full(len(c.words), -1)
    for k, word in enumerate(c.words):
        rank[k] = anchors.get(word, -1)
    has = np.flatnonzero(rank[c.at] >= 0)
    order = has[np.lexsort((rank[c.at[has]], -c.n[has], c.doc[has]))]
    docs, first = np.unique(c.doc[order], return_index=True)
    kind[docs] = rank[c.at[order[first]]] + 1
    return kind


def _shared(c: Counted, kind: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words by class (the class in front), the ends of the classes behind them (no letters); which of them
    each entry is; their count in the training texts."""
    pairs, which = np.unique(kind[c.doc] * len(c.words) + c.at, return_inverse=True)
    marks = [bytes([FIRST_CLASS + k]) for k in range(kind.max(initial=0) + 1)]
    classes, words = np.divmod(pairs, max(len(c.words), 1))
    names = [marks[k] + c.words[w] for k, w in zip(classes.tolist(), words.tolist(), strict=True)]
    taught = np.bincount(which, c.n * c.train[c.doc], len(pairs)).astype(np.int64)
    ends, of = np.unique(kind, return_inverse=True)
    return names + [marks[k] for k in ends], which, np.concatenate([taught, np.bincount(of, c.train, len(ends)).astype(np.int64)])


def _by_bucket(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by bucket, whatever their class, and the sorted buckets."""
    bucket = np.fromiter((zlib.crc32(w[1:]) % buckets for w in words), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _questions(words: list[bytes], n: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    order, bucket = _by_bucket(words, buckets)
    for b, here in cuts(bucket):
        a = zstandard.ZstdCompressor(level=1).compress(b" ".join(words[i] for i in order[here]))
        yield b, len(a).to_bytes(8, "little") + a + pack(n[order[here]])


def _asked_words(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    return zstandard.ZstdDecompressor().decompress(blob[8 : 8 + n]).split(b" "), unpack(blob[8 + n :], "i8")


def _totals(blobs: list[bytes]) -> tuple[dict[bytes, int], list[tuple[list[bytes], np.ndarray]]]:
    parts, total = [_asked_words(x) for x in blobs], {}
    for words, counts in parts:
        for word, n in zip(words, counts.tolist(), strict=True):
            total[word] = total.get(word, 0) + n
    return total, parts


@lru_cache(maxsize=2)
def _strings(path: str) -> tuple[list[str], list[int]]:
    """Vocabulary strings by id (empty for control symbols), and the id of each byte."""
    model = processor(path)
    strings, of_byte = [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
        strings.append("" if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else piece)
    return strings, of_byte


class Lattice:
    """Log probability (natural) of words, each under the row of `weights` (class, string id) that its class names."""

    def __init__(self, path: str, weights: np.ndarray) -> None:
        strings, self.of_byte = _strings(path)
        self.weights = weights
        self.id = {s: i for i, s in enumerate(strings) if s}
        self.longest = max(map(len, self.id))
        several = [s for s in self.id if len(s) > 1]
        keys = np.array([self._key(s) for s in several], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([self.id[s] for s in several])[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two vocabulary strings with one hash")
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    MULTIPLY = np.uint64(0x9E3779B97F4A7C15)

    def _key(self, s: str) -> int:
        x = 0
        for c in s:
            x = (x ^ ord(c)) * int(self.MULTIPLY) & ((1 << 64) - 1)
            x ^= x >> 29
        return x

    def char(self, c: str) -> np.ndarray:
        """For each class: a string of its own, or else its bytes."""
        return self.weights[:, self.id[c]] if c in self.id else sum(self.weights[:, self.of_byte[b]] for b in c.encode())

    def one(self, word: str, kind: int) -> float:
        s, weights = SPACE + word, self.weights[kind]
        alpha, single = [0.0], {c: float(self.char(c)[kind]) for c in set(s)}
        for j in range(1, len(s) + 1):
            arcs = [alpha[j - 1] + single[s[j - 1]]]
            arcs += [alpha[i] + weights[self.id[s[i:j]]] for i in range(max(0, j - self.longest), j - 1) if s[i:j] in self.id]
            alpha.append(float(np.logaddexp.reduce(arcs)))
        return alpha[-1]

    def same_length(self, words: list[str], kinds: np.ndarray, n: int) -> np.ndarray:
        """The forward recursion for words of `n` characters side by side."""
        chars = np.full((len(words), n + 1), ord(SPACE), np.uint64)
        chars[:, 1:] = np.array(words, f"<U{n}").view("<u4").reshape(len(words), n)
        letters, where = np.unique(chars, return_inverse=True)
        single = np.stack([self.char(chr(int(k))) for k in letters])[where.reshape(chars.shape), kinds[:, None]]
        alpha = np.full((len(words), n + 2), -np.inf)
        alpha[:, 0] = 0.0
        for i in range(n + 1):
            alpha[:, i + 1] = np.logaddexp(alpha[:, i + 1], alpha[:, i] + single[:, i])
            key = np.zeros(len(words), np.uint64)
            for j in range(i, min(i + self.longest, n + 1)):
                key = (key ^ chars[:, j]) * self.MULTIPLY
                key ^= key >> np.uint64(29)
                if j == i:
                    continue
                rows = np.flatnonzero(self.marks[(key >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                same = self.keys[at] == key[rows]
                rows, at = rows[same], at[same]
                alpha[rows, j + 1] = np.logaddexp(alpha[rows, j + 1], alpha[rows, i] + self.weights[kinds[rows], self.ids[at]])
        return alpha[:, -1]

    def score(self, words: list[str], kinds: np.ndarray) -> np.ndarray:
        out = np.empty(len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for part in np.array_split(rows, -(-len(rows) // 20_000)):
                some = [words[i] for i in part]
                plain = 0 < n <= WIDE and not any("\0" in w for w in some)
                out[part] = self.same_length(some, kinds[part], int(n)) if plain else [self.one(w, k) for w, k in zip(some, kinds[part], strict=True)]
        return out


class Learned(NamedTuple):
    """What the driver holds of the training texts. Last row of `words`, `distinct`, `ends`: all classes."""

    weights: np.ndarray  # log weight of each string, by class
    words: np.ndarray
    distinct: np.ndarray
    ends: np.ndarray


def common_words(questions: DataFrame, most: int) -> dict[bytes, int]:
    """Places of the `most` commonest training words; of equal ones, those that sort first."""

    def top(table: pa.Table) -> pa.Table:
        total = _totals(table["blob"].to_pylist())[0]
        best = heapq.nsmallest(most, ((-n, w[1:]) for w, n in total.items() if n and len(w) > 1))
        return pa.table({"word": pa.array([w for _, w in best], pa.binary()), "n": pa.array([-n for n, _ in best], pa.int64())})

    found = questions.groupBy("bucket").applyInArrow(top, "word binary, n long").orderBy(F.desc("n"), "word").limit(most)
    return {bytes(row.word): k for k, row in enumerate(found.collect())}


def learned(questions: DataFrame, path: str, classes: int, smooth: float, backing: float) -> Learned:
    """Weights of all vocabulary strings in each class, and its numbers of training words, distinct words and texts.

    Only sums for each class and vocabulary string come to the driver."""
    size = processor(path).get_piece_size()
    width = size + 3

    def count(table: pa.Table) -> pa.Table:
        total = {w: n for w, n in _totals(table["blob"].to_pylist())[0].items() if n}
        keys = [w for w in total if len(w) > 1]
        place = {w: k for k, w in enumerate(dict.fromkeys(w[1:] for w in keys))}
        names, model, lengths, flat = list(place), processor(path), [], [np.empty(0, np.int64)]
        for part in range(0, len(names), 50_000):
            ids = model.encode([w.decode() for w in names[part : part + 50_000]], num_threads=1)
            lengths += map(len, ids)
            flat.append(np.fromiter((i for x in ids for i in x), np.int64))
        pieces, long = np.concatenate(flat), np.array(lengths, np.int64)
        kind = np.fromiter((w[0] - FIRST_CLASS for w in keys), np.int64, len(keys))
        which = np.fromiter((place[w[1:]] for w in keys), np.int64, len(keys))
        n = np.fromiter((total[w] for w in keys), np.int64, len(keys))
        sums = np.zeros((classes + 1, width), np.int64)
        sums[classes] = np.bincount(pieces, minlength=width)
        begins = np.cumsum(long) - long
        for k in np.unique(kind):
            here = which[kind == k]
            at = np.repeat(begins[here] - (np.cumsum(long[here]) - long[here]), long[here]) + np.arange(long[here].sum())
            sums[k] = np.bincount(pieces[at], minlength=width)
            sums[k, size : size + 2] = n[kind == k].sum(), len(here)
        sums[classes, size : size + 2] = n.sum(), len(names)
        for w, ends in total.items():
            if len(w) == 1:
                sums[[w[0] - FIRST_CLASS, classes], size + 2] += ends
        at = np.flatnonzero(sums)
        return pa.table({"at": pa.array(at), "n": pa.array(sums.reshape(-1)[at])})

    found = questions.groupBy("bucket").applyInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((classes + 1) * width)
    sums[found["at"].to_numpy()] = found["n"].to_numpy()
    sums = sums.reshape(classes + 1, width)
    whole = sums[classes, :size] + smooth
    each = sums[:classes, :size] + backing * whole / whole.sum()
    return Learned(np.log(each / each.sum(1, keepdims=True)), *sums[:, size:].T)


def word_scores(model: Learned, path: str, words: list[bytes], counts: np.ndarray, everywhere: np.ndarray, discount: float) -> np.ndarray:
    """Natural log probability of words (their class in front) from their training counts in the class and in all."""
    kinds = np.fromiter((w[0] - FIRST_CLASS for w in words), np.int64, len(words))
    out = Lattice(path, model.weights).score([w[1:].decode() for w in words], kinds)
    last = np.full(len(words), len(model.words) - 1)
    with np.errstate(divide="ignore"):
        for n, of in ((everywhere, last), (counts, kinds)):
            all_, types = model.words[of], model.distinct[of]
            some = np.maximum(all_, 1)
            mixed = np.logaddexp(np.log(np.maximum(n - discount, 0) / some), np.log(discount * types / some) + out)
            out = np.where(all_ > 0, mixed, out)
    return out


SCORED = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, path: str, train: Column, doc_id: str = "doc_id", text: str = "text", smooth: float = 0.5, anchors: int = 32, backing: float = 300.0, discount: float = 0.75, chunk_bytes: int = 8 << 20, bucket_words: int = 2 << 20) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of every text.

    `train` marks the rows to learn from. Tokens are words of the text with A-Z lowered, and one end, which is known
    if any row is learned from. `base_score` is the unigram of whole words with 0.5 added, as a measure to compare
    with. `anchors` (at most 100) common words make the classes. A class's strings count as often as its distinct
    words have them, plus `backing` shared out as all classes have them, each with `smooth` added; `discount` comes
    off the count of each distinct word. A null or empty text is its end alone; repeated rows count and are scored
    each; a null id stays null, ids are integers, and a null mark does not teach; other columns of `docs` are not read; an empty
    table gives an empty one."""
    if not 0 <= anchors <= 100:
        raise ValueError("a class must fit into one byte")
    learns = F.coalesce(train, F.lit(False))
    kind = docs.schema[doc_id].dataType.simpleString()
    chunks = counted(docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"), learns.alias("train")), chunk_bytes)
    buckets = bucket_count(chunks, bucket_words)

    def ask(places: dict[bytes, int]) -> DataFrame:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                    c = _opened(blob)
                    words_, _, taught = _shared(c, _classes(c, places))
                    yield packed(name, _questions(words_, taught, buckets))

        return chunks.select("chunk", "blob").mapInArrow(make, ASKED)

    places = common_words(ask({}), anchors)
    questions = stored(ask(places))
    classes = len(places) + 1
    model = learned(questions, path, classes, smooth, backing)
    words, distinct, ends = int(model.words[-1]), int(model.distinct[-1]), int(model.ends[-1])
    n, v = words + ends, distinct + bool(ends)
    # by class: its share of the texts, and the share of ends among its tokens, drawn towards that of all
    share = np.log((model.ends[:-1] + smooth) / (ends + smooth * classes))
    stops = (model.ends[:-1] + (ends + smooth) / (n + 1)) / (model.words[:-1] + model.ends[:-1] + 1)

    def answer(blobs: list[bytes]) -> list[bytes]:
        total, parts = _totals(blobs)
        everywhere: dict[bytes, int] = {}
        for w, c in total.items():
            everywhere[w[1:]] = everywhere.get(w[1:], 0) + c
        names = [w for w in total if len(w) > 1]
        counts = np.fromiter((total[w] for w in names), np.int64, len(names))
        whole = np.fromiter((everywhere[w[1:]] for w in names), np.int64, len(names))
        score = dict(zip(names, word_scores(model, path, names, counts, whole, discount).tolist(), strict=True))
        out = []
        for asked_words, _ in parts:
            a = pack(np.fromiter((everywhere[w[1:]] for w in asked_words), np.int64, len(asked_words)))
            out.append(len(a).to_bytes(8, "little") + a + pack(np.fromiter((score.get(w, 0.0) for w in asked_words), np.float64, len(asked_words))))
        return out

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SCORED.empty_table()
        c = _opened(table["blob"][0].as_py())
        k = _classes(c, places)
        shared, which, _ = _shared(c, k)
        found = dict(zip(replies["bucket"].to_pylist(), replies["blob"].to_pylist(), strict=True))
        order, bucket = _by_bucket(shared, buckets)
        count, weight = np.empty(len(shared), np.int64), np.empty(len(shared))
        for b, here in cuts(bucket):
            size = int.from_bytes(found[b][:8], "little")
            count[order[here]] = unpack(found[b][8 : 8 + size], "i8")
            weight[order[here]] = unpack(found[b][8 + size :], "f8")
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        summed = lambda x: np.bincount(c.doc, c.n * x, len(c.ids))
        long = summed(1.0)
        whole = share[k] + long * np.log1p(-stops[k]) + np.log(stops[k]) + summed(weight[which])
        known = summed(count[which] > 0) + bool(ends)
        plain = summed(base[which]) + log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        return pa.table([pa.array(c.ids, pa.int64()), pa.array(c.train), pa.array(long.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(plain), pa.array(whole / LN10)], schema=SCORED)

    answers = answered(questions, answer)
    out = chunks.select("chunk", "blob").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
