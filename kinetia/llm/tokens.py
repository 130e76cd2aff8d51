"""Words of whole Arrow text batches as numpy arrays: places, documents and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: As _SPACE, with the ASCII marks: words are runs of letters, digits and what isn't ASCII.
MARKS = np.array([not (chr(c).isalnum() or c > 127) for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.array([65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c > 127 else 48 if 48 <= c < 58 else c for c in range(256)], np.uint8)
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256).astype(np.uint64)  # fixed by the seed: hashes must agree between tasks
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    data: np.ndarray  #: the texts' bytes, one after another
    starts: np.ndarray  #: of each word in data
    ends: np.ndarray
    doc: np.ndarray  #: each word's text, by number
    first: np.ndarray  #: of each text, the number of its first word; one more at the end
    hash: np.ndarray | None

    def __len__(self) -> int:
        return len(self.starts)


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True, hashed: bool = True, space: np.ndarray = _SPACE) -> Words:
    """data: bytes of texts; bounds: where each begins, and the end; space: by byte, whether it parts words."""
    n = len(data)
    inside = ~space[data]
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    start = inside & (~before | begins[:n])
    after = np.concatenate([inside[1:], [False]]) if n else inside
    end = inside & (~after | begins[1:])
    starts, ends = np.nonzero(start)[0], np.nonzero(end)[0] + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    first = np.searchsorted(starts, bounds)
    h = None
    if hashed:
        up, down = _powers(n + 1)
        value = _VALUE[_LOWER[data] if lower else data]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * up[:n], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, doc, first, h)


def shapes(w: Words) -> np.ndarray:
    """Hashes of the words with each run of capitals, of small and other letters, of digits or of one mark as one sign."""
    sign = _SIGN[w.data]
    kept = np.ones(len(sign), bool)
    kept[1:] = sign[1:] != sign[:-1]
    kept[w.starts] = True
    rank = np.concatenate([[0], np.cumsum(kept)])
    up, down = _powers(len(sign) + 1)
    sums = np.zeros(len(sign) + 1, np.uint64)
    np.cumsum(np.where(kept, _VALUE[sign] * up[rank[:-1]], np.uint64(0)), out=sums[1:])
    return mix((sums[w.ends] - sums[w.starts]) * down[rank[w.starts]])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs that begin at each word. Runs over the end wrap round: callers mask them."""
    out = h.copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + np.roll(h, -k))
    return out


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text begins in them, and the end. Nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 3_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches of about so many bytes of text, with the bytes and bounds of their texts. A longer text is a slice of its own."""
    for b in batches:
        data, at = raw(b.column(column))
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield b.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def hashes(text: str, space: np.ndarray = _SPACE) -> np.ndarray:
    """Word hashes of one text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return words(data, np.array([0, len(data)]), space=space).hash


class Runs:
    """Hashes of any runs of words of a chunk, from one pass of prefix sums."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def hash(self, start: np.ndarray, n: int) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start])


class Slots:
    """Numbers of known hashes, by open addressing."""

    def __init__(self, known: np.ndarray):
        self.known, self.mask = known, np.uint64((1 << max(8, int(len(known) * 6).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(known)), (known & self.mask).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, the last one has it
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & int(self.mask)

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 for others."""
        at = (h & self.mask).astype(np.int64)
        out = self.slots[at]
        wrong = np.nonzero(out >= 0)[0]
        wrong = wrong[self.known[out[wrong]] != h[wrong]]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[out[wrong] >= 0]
            wrong = wrong[self.known[out[wrong]] != h[wrong]]
        return out.astype(np.int64)
