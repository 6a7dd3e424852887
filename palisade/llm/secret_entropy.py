"""Secrets in texts: three known forms, and strings that look random.

A string looks random where the Shannon entropy of a window that slides over it is high. What is high depends on the
alphabet, so every character class has a window and a threshold of its own, and is looked for in the runs of its
characters. The entropy of a window of w characters is log2(w) - sum(c * log2(c)) / w over its counts c. When the
window moves by one, one count falls and one rises, so the sum changes by two differences of a table; the counts come
from the places of equal characters, for all runs of a batch at once. The table is in fixed point, so that sums are
exact however long a run is.

Strings on the allow-list, and those that a known form has found already, are not reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import slices, utf8

Span = tuple[str, int, int]  # kind, start, end

# The known forms, in the order in which spans with one start are listed.
KNOWN = ["assign", "access", "hex"]
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")  # on lower-cased text
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGNED = 8


@dataclass(frozen=True)
class CharClass:
    """Runs of `chars` (a regex class) are tested with windows of `window` characters: `bits` or more are high."""

    kind: str
    chars: str
    window: int
    bits: float


#: Narrow classes first: a span within one of an earlier class is not reported again.
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 24, 3.0),
    CharClass("entropy_alnum", "0-9A-Za-z", 20, 3.75),
    CharClass("entropy_base64", "0-9A-Za-z+/_=-", 20, 3.9),
)
#: What a run may be without being a secret: words with or without separators, numbers, UUIDs, alphabets, samples.
ALLOWED = (
    r"^[A-Za-z]+(?:[+/_=-]+[A-Za-z]+)*[+/_=-]*$",
    r"^[0-9+/_=-]+$",
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"(?i)0123456789|abcdefghij",
    r"(?i)example|sample|dummy|placeholder|change_?me",
)
#: Fractions of a bit in the table.
UNIT = 1 << 36


def table(window: int) -> np.ndarray:
    """c * log2(c) in units, for counts up to a window."""
    return np.array([0] + [round(c * log2(c) * UNIT) for c in range(1, window + 1)], np.int64)


def limit(window: int, bits: float) -> int:
    """The largest sum of c * log2(c) at which a window has `bits` of entropy."""
    return int((log2(window) - bits) * window * UNIT)


def windows(runs: Sequence[bytes], window: int) -> np.ndarray:
    """For each character of the joined runs the sum of c * log2(c) over the window that ends there, or over the part
    of it that lies in the run."""
    lengths = np.array([len(r) for r in runs], np.int64)
    chars = np.frombuffer(b"".join(runs), np.uint8).astype(np.int64)
    run = np.repeat(np.arange(len(runs)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(chars))
    # equal characters of a run stand together, in their order: a count is a difference of two places there
    span = len(chars) + 1
    key = (run * 256 + chars) * span
    together = np.sort(key + place)
    own = np.searchsorted(together, key + place)
    c = table(window)
    before = own - np.searchsorted(together, key + np.maximum(place - window + 1, 0))
    change = c[before + 1] - c[before]  # the character comes in, when the one `window` before it has gone
    leaves = np.flatnonzero(place - window >= first)
    gone = place[leaves] - window
    held = np.searchsorted(together, key[gone] + place[leaves]) - own[gone]
    change[leaves] += c[held - 1] - c[held]
    sums = np.cumsum(change)
    return sums - np.concatenate([[0], sums])[first]


def high_spans(runs: Sequence[bytes], of: CharClass) -> Iterator[tuple[int, int, int]]:
    """(run, start, stop) of what windows of high entropy cover."""
    if not runs:
        return
    lengths = np.array([len(r) for r in runs], np.int64)
    starts = np.cumsum(lengths) - lengths
    run = np.repeat(np.arange(len(runs)), lengths)
    place = np.arange(len(run)) - starts[run]
    high = (windows(runs, of.window) <= limit(of.window, of.bits)) & (place >= of.window - 1)
    ends = np.flatnonzero(high)
    if not len(ends):
        return
    new = np.flatnonzero((np.diff(ends) > of.window) | (np.diff(run[ends]) > 0)) + 1
    for a, b in zip(np.r_[0, new], np.r_[new, len(ends)] - 1, strict=True):
        r = int(run[ends[a]])
        yield r, int(place[ends[a]]) - of.window + 1, int(place[ends[b]]) + 1


def known_spans(data: bytes) -> list[Span]:
    """Spans of the known forms, in bytes."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= ASSIGNED]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(data)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(data)]


class Finder:
    """Spans of many texts at once."""

    def __init__(self, classes: Sequence[CharClass], allowed: Iterable[str]) -> None:
        self.classes = classes
        self.order = {kind: k for k, kind in enumerate([*KNOWN, *(c.kind for c in classes)])}
        self.allowed = [re.compile(p.encode()) for p in allowed]
        self.runs = [re.compile(f"(?<![{c.chars}])[{c.chars}]{{{c.window},}}".encode()) for c in classes]

    def spans(self, texts: list[bytes]) -> list[list[Span]]:
        """For each text (kind, start, end) in bytes, by start, then kind."""
        known = [known_spans(t) for t in texts]
        added: list[list[Span]] = [[] for _ in texts]
        for of, pattern in zip(self.classes, self.runs, strict=True):
            at = [(k, m.start(), m.group()) for k, t in enumerate(texts) for m in pattern.finditer(t)]
            at = [x for x in at if not any(p.search(x[2]) for p in self.allowed)]
            for r, start, stop in high_spans([x[2] for x in at], of):
                text, offset, _ = at[r]
                added[text].append((of.kind, offset + start, offset + stop))
        return [self._ordered(k, a) for k, a in zip(known, added, strict=True)]

    def _ordered(self, known: list[Span], added: list[Span]) -> list[Span]:
        """Without the added spans that meet a known one or lie within one of a narrower class."""
        found = {kind: sorted(s for s in known if s[0] == kind) for kind in KNOWN}
        for of in self.classes if added else ():
            narrower = [spans for kind, spans in found.items() if kind not in KNOWN]
            fresh = sorted(s for s in added if s[0] == of.kind and not any(_meets(found[kind], s) for kind in KNOWN))
            found[of.kind] = [s for s in fresh if not any(_within(spans, s) for spans in narrower)]
        return sorted((s for spans in found.values() for s in spans), key=lambda s: (s[1], self.order[s[0]]))


def _last(spans: list[Span], start: int) -> int:
    """The end of the last span that begins before `start`; spans of one kind do not overlap."""
    k = bisect_left(spans, start, key=lambda s: s[1])
    return spans[k - 1][2] if k else -1


def _meets(spans: list[Span], span: Span) -> bool:
    return _last(spans, span[2]) > span[1]


def _within(spans: list[Span], span: Span) -> bool:
    return _last(spans, span[1] + 1) >= span[2]


SPANS = "array<struct<kind:string,start:bigint,stop:bigint,known:boolean>>"


def find_secrets(docs: DataFrame, classes: Sequence[CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: spans of `kind`, from code point `start` to before `stop`, by start and then in
    the order of KNOWN and `classes`; `known` for the three known forms, whose matches are leftmost and do not overlap.

    `allowed` holds regular expressions; a run of a class that one of them finds something in is no secret. Known forms
    are reported whatever the list says. A null or empty text has no spans; ids may be null or repeated, each row
    gives one; an empty table gives an empty one; other columns are not read."""
    finder = Finder(tuple(classes), tuple(allowed))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("known", pa.bool_())])
        for batch in slices(batches, "text"):
            texts = utf8(batch.column("text"))
            out = []
            for data, spans in zip(texts, finder.spans(texts), strict=True):
                if spans and not data.isascii():
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                    spans = [(kind, int(points[a]), int(points[b])) for kind, a, b in spans]
                out.append([{"kind": kind, "start": a, "stop": b, "known": kind in KNOWN} for kind, a, b in spans])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.list_(item))], ["doc_id", "spans"])

    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
