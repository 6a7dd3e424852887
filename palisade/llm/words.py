"""Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, their hashes and rolling hashes, a whole chunk of texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from palisade.llm.common import mixed

#: Bytes that end a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (BASE, INVERSE):
        x = np.full(n, factor, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(BLOCK + 1, 1 << (n - 1).bit_length()))


def spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind it."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[buffer]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_count(text: bytes) -> int:
    return len(spans(np.frombuffer(text, np.uint8))[0]) if len(text) > 4096 else len(text.split())


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word: differences of prefix sums over blocks of the bytes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        part = buffer[base : ends[j - 1]]
        up, down = _up_to(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_letters()[part] * up[: len(part)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mixed(out)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """64 bits for each run of `width` words, by its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _up_to(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[:n])


class Layout:
    """The texts of a chunk side by side: hashes of all words, and the words `[first[d], last[d])` of each text."""

    def __init__(self, texts: list[bytes]) -> None:
        buffer = np.frombuffer(b" ".join(texts), np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts, ends = spans(buffer)
        self.hashes = word_hashes(buffer, starts, ends)
        bounds = np.searchsorted(starts, begins)
        self.first, self.last = bounds[:-1], bounds[1:]
        self.doc = np.repeat(np.arange(len(texts)), self.last - self.first)
        self.n = len(starts)

    def fits(self, width: int) -> np.ndarray:
        """First words of the runs of `width` words that stay in their text."""
        at = np.arange(max(0, self.n - width + 1))
        return at[at + width <= self.last[self.doc[at]]]
