"""Words of many texts at once: places and 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

import numpy as np

SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[SPACES] = False
#: Letters and digits of ASCII, and every byte of a longer UTF-8 character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.Generator(np.random.PCG64(20260916)).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < length + 1:
        size = max(length + 1, 1 << 20)
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which every bit depends on every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Maximal runs of `kind` bytes inside each text: `starts`, `ends`, `doc` (text number), `hashes`."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True):
        self.text = LOWER[text] if lower else text
        inside = np.zeros(len(text) + 1, bool)
        inside[:-1] = kind[text]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes = ~inside
        finishes[1:] &= inside[:-1]
        finishes[0] = False
        # a text ends where the next one begins, whatever stands there
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(text))]
        cut = edges[inside[edges] & inside[edges - 1]]
        begins[cut] = True
        finishes[cut] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self._sums: np.ndarray | None = None

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each span of bytes; equal bytes have equal hashes, wherever they stand."""
        up, down = _power_tables(len(self.text))
        if self._sums is None:
            self._sums = np.zeros(len(self.text) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[self.text] * up[:len(self.text)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts])

    @property
    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words and the text of each; a text of fewer words has one run of all of them."""
    hashes, doc, step = words.hashes, words.doc, np.uint64(0xD6E8FEB86659FD93)
    parts, docs = [], []
    if len(hashes) >= size:
        total = np.zeros(len(hashes) - size + 1, np.uint64)
        for i in range(size):
            total = total * step + hashes[i:len(hashes) - size + 1 + i]
        whole = doc[:len(total)] == doc[size - 1:]
        parts.append(total[whole])
        docs.append(doc[:len(total)][whole])
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        firsts = np.searchsorted(doc, short)
        sums = []
        for first, number in zip(firsts, words.count[short], strict=True):
            total = np.uint64(number)
            with np.errstate(over="ignore"):
                for h in hashes[first:first + number]:
                    total = total * step + h
            sums.append(total)
        parts.append(np.array(sums, np.uint64))
        docs.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix(np.concatenate(parts)), np.concatenate(docs)
