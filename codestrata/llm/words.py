"""Vectorised words of many texts at once: ASCII-white-space words, 64-bit word hashes, shingles.

Texts are UTF-8 ``bytes``. A block of texts is one buffer; all arrays are
bounded by the block, and ``blocks`` cuts a batch so that a block holds about
``BLOCK_BYTES`` (or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1 << 20

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: As lower-case words, with ASCII punctuation read as white space.
PLAIN = LOWER.translate(bytes.maketrans(_SIGNS, b" " * len(_SIGNS)))
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(texts: Iterable[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) for runs of about ``size`` bytes."""
    run: list[bytes] = []
    first = total = 0
    for k, text in enumerate(texts):
        if run and total + len(text) > size:
            yield first, run
            run, first, total = [], k, 0
        run.append(text)
        total += len(text) + 1
    if run:
        yield first, run


class Words:
    """The words of a block of texts.

    ``data``: the texts, each followed by a space, each run of white space one
    space; ``starts``/``ends``: each word's bytes in it; ``first``: for each
    text the index of its first word, then the number of words.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, table: bytes | None = None):
        joined = b"\n".join([*texts, b""]).translate(table or (LOWER if lower else _BLANK))
        raw = np.frombuffer(joined, np.uint8)
        blank = raw == 32
        before = np.empty_like(blank)
        before[:1] = True
        before[1:] = blank[:-1]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate(([0], np.cumsum(lengths + 1)))
        begun = np.flatnonzero(before & ~blank)
        self.first = np.searchsorted(begun, edges)
        keep = ~(blank & before)
        self.data = joined if keep.all() else raw[keep].tobytes()
        self.array = np.frombuffer(self.data, np.uint8)
        blank = self.array == 32
        self.ends = np.flatnonzero(blank)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = _power(len(self.array) + 1)
        total = np.zeros(len(self.array) + 1, np.uint64)
        np.cumsum(_BYTE[self.array] * power[: len(self.array)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, last word) of each run of ``width`` words, of the whole text where it is shorter."""
        n = np.where(self.counts >= width, self.counts - width + 1, np.minimum(self.counts, 1))
        text = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        head = self.first[text] + offset
        return text, head, np.minimum(head + width, self.first[text + 1]) - 1

    def shingle_hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, 64-bit hash) of each shingle, from its words' hashes in their order."""
        h = self.hashes()
        text, head, tail = self.shingles(width)
        out = np.zeros(len(text), np.uint64)
        for k in range(width):
            at = head + k
            inside = at <= tail
            part = np.where(inside, h[np.minimum(at, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else out
            out = out * np.uint64(_BASE) + part
        return text, mix(out)
