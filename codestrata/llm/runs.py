"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of a text's words with smallest period q that no neighbouring
word extends and that is at least ``max(least, 2 * q)`` words long. Within one
text:

1. the suffix tree, held as the suffix array with its LCP intervals, is built by
   prefix doubling; the ranks of all doublings answer common extensions;
2. the Lempel-Ziv blocks give pairs (start, period) that cover the leftmost
   occurrence of each square: for each block and each period up to the block's
   and its successor's length, one extension ahead and one behind;
3. a walk along suffix links from each covering square (its rotations: the locus
   of (i, d) links to that of (i + 1, d - 1), the square's first word leads on)
   completes the vocabulary of squares;
4. the leaves below each square's locus are its occurrences, and occurrences of
   one period at consecutive words merge into runs.

Only squares of primitive roots are kept, so a period is the smallest one. All
texts of a block share one suffix tree: a word's number includes its stretch.
Before that, words that cannot lie in a run leave: each word of a run lies in a
six-gram that stands twice in its text (for ``least`` of 12), so texts are cut
into stretches of such words, again and again until nothing changes. This only
drops what no run can hold; six-grams are compared by 64-bit hashes, whose
collisions merely keep more.

Defined cases: null is the empty text, without words or runs; repeated rows are
rows of their own; other columns are kept (``collapsed`` and the like replace a
column of the same name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.arrow import column, map_rows, utf8
from codestrata.llm.words import blocks, mix

LEAST = 12
#: Texts of about so many bytes are worked on together.
RUN_BYTES = 3 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _stands_twice(h: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once."""
    out = np.zeros(len(h), bool)
    bits = max(10, int(len(h)).bit_length() + 2)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    order = at[np.argsort(h[at])]
    same = h[order[1:]] == h[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def stretches(ids: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch of each) of the words that a run may hold; ``group`` (not decreasing) tells texts apart."""
    width = max(1, least // 2)
    place, parts = np.arange(len(ids)), -1
    while len(place):
        before, parts_before = len(place), parts
        n = max(0, before - width + 1)
        h = group[:n].astype(np.uint64) * _STEP
        for k in range(width):
            h = h * _BASE + ids[k : k + n].astype(np.uint64)
        whole = np.flatnonzero(group[:n] == group[width - 1 : width - 1 + n])
        head = whole[_stands_twice(mix(h[whole]))]
        edge = np.zeros(before + 1, np.int64)
        np.add.at(edge, head, 1)
        np.add.at(edge, head + width, -1)
        held = np.cumsum(edge)[:-1] > 0
        new = held.copy()
        new[1:] &= ~held[:-1] | (group[1:] != group[:-1])
        stretch = np.cumsum(new) - 1
        keep = held.copy()
        if held.any():
            keep[held] = np.bincount(stretch[held])[stretch[held]] >= least
        place, ids, group = place[keep], ids[keep], stretch[keep]
        parts = int(new.sum())
        if len(place) == before and parts == parts_before:
            break
    return place, group


class SuffixTree:
    """The suffix array of a sequence with its LCP intervals; ``group`` tells sequences apart that share it."""

    def __init__(self, ids: np.ndarray, group: np.ndarray):
        n = self.n = len(ids)
        key = group.astype(np.int64) * (int(ids.max()) + 1) + ids
        order = np.argsort(key, kind="stable")
        rank, rest = self._ranked(np.zeros(n + 1, np.int64), key[order], order, np.zeros(n, np.int64))
        self.levels = [rank]
        step = 1
        while len(rest):
            after = np.where(rest + step <= n, rest + step, n)
            key = rank[rest] * (n + 2) + rank[after] + 1
            order = np.argsort(key, kind="stable")
            rank, rest = self._ranked(rank.copy(), key[order], rest[order], rank[rest[order]])
            self.levels.append(rank)
            step *= 2
        self.levels = [level.astype(np.int32) for level in self.levels]
        self.rank = rank[:n]
        self.array = np.empty(n, np.int64)
        self.array[self.rank] = np.arange(n)
        self.lcp = np.zeros(n, np.int64)
        self.lcp[1:] = self.ahead(self.array[:-1], self.array[1:])

    @staticmethod
    def _ranked(rank: np.ndarray, key: np.ndarray, at: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks refined by sorted keys, and the places whose rank is still shared."""
        place = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, place, 0))
        begun = np.ones(len(key), bool)
        begun[1:] = old[1:] != old[:-1]
        rank[at] = old + first - np.maximum.accumulate(np.where(begun, place, 0))
        rank[-1] = -1  # the end
        alone = new.copy()
        alone[:-1] &= new[1:]
        return rank, at[~alone]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal (i and j differ)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            out += (level[np.minimum(i + out, self.n)] == level[np.minimum(j + out, self.n)]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal (i below j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            level = self.levels[k]
            out += ((a >= 0) & (level[np.maximum(a, 0)] == level[np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` (1 or more) words from i and from j on are equal: two overlapping doublings."""
        out = np.zeros(len(i), bool)
        top = np.frexp(length.astype(np.float64))[1] - 1
        for k in np.unique(top):
            at = np.flatnonzero(top == k)
            if k < len(self.levels):  # longer ones stand once
                level, last = self.levels[k], length[at] - (1 << int(k))
                out[at] = (level[i[at]] == level[j[at]]) & (level[i[at] + last] == level[j[at] + last])
        return out

    def earlier(self) -> np.ndarray:
        """At each place, how many words from there on stand from an earlier place on too."""
        out = np.zeros(self.n, np.int64)
        for side in (-1, 1):
            near = np.arange(self.n) + side
            near[near == self.n] = -1
            open_ = np.flatnonzero(near >= 0)
            while len(open_ := open_[near[open_] >= 0]) and len(open_ := open_[self.array[near[open_]] > self.array[open_]]):
                near[open_] = near[near[open_]]
            found = near >= 0
            here = self.array[found]
            out[here] = np.maximum(out[here], self.ahead(self.array[near[found]], here))
        return out

    def loci(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the locus of ``length`` words from i on."""
        least, most = self.rank[i].copy(), self.rank[i].copy()
        tables = [self.lcp]
        while 2 << (len(tables) - 1) < self.n:
            half, low = 1 << (len(tables) - 1), tables[-1]
            tables.append(np.minimum(low[:-half], low[half:]))
        for k in range(len(tables) - 1, -1, -1):
            low, width = tables[k], 1 << k
            to = most + 1
            most += ((to < len(low)) & (low[np.minimum(to, len(low) - 1)] >= length)) * width
            to = least - width + 1
            least -= ((to > 0) & (low[np.clip(to, 0, len(low) - 1)] >= length)) * width
        return least, most


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) for the values start, start + 1, ... of each range."""
    of = np.repeat(np.arange(len(count)), count)
    return of, start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def covering(tree: SuffixTree, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, period) of the repeats that cover each square's leftmost occurrence."""
    step = np.maximum(tree.earlier(), 1).tolist()
    heads, at = [], 0
    while at < tree.n:
        heads.append(at)
        at += step[at]
    h = np.array([*heads, tree.n])
    own = np.append(group[h[:-1]], -1)
    size = np.diff(h)
    following = np.append(size[1:], 0) * (own[1:] == own[:-1])
    # Centres in a block whose squares reach into the next one: q is k words before the next block.
    block, k = _ranges(np.ones(len(size), np.int64), np.where(following > 0, size, 0))
    a1, b1, k1 = h[block + 1] - k, h[block + 1], k
    # Squares around a block's head, up to both blocks' length: q is k words after it.
    block, k = _ranges(np.ones(len(size), np.int64), np.maximum(size + following - 1, 0))
    a, b, k = np.concatenate((a1, h[block])), np.concatenate((b1, h[block] + k)), np.concatenate((k1, k))
    after = tree.ahead(a, b)
    at = np.flatnonzero(after > 0)
    a, b, k, after = a[at], b[at], k[at], after[at]
    before = tree.behind(a, b)
    at = np.flatnonzero(after + before >= k)
    return (a - before)[at], (b + after)[at], k[at]


def _primitive(tree: SuffixTree, left: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the squares of these periods have primitive roots: no prime part of the period is a period too."""
    out = np.ones(len(left), bool)
    if not len(left):
        return out
    factor = np.arange(int(period.max()) + 1)
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            part = factor[p * p :: p]
            part[part == np.arange(p * p, len(factor), p)] = p
    rest = period.copy()
    while len(at := np.flatnonzero(rest > 1)):
        p = factor[rest[at]]
        smaller = period[at] // p
        out[at] &= ~tree.equal(left[at], left[at] + smaller, 2 * period[at] - smaller)
        while len(more := at[rest[at] % p == 0]):
            rest[more] //= p[rest[at] % p == 0]
    return out


def find(ids: np.ndarray, group: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of word numbers by start, then period; ``group`` (not decreasing) tells texts apart."""
    none = np.zeros(0, np.int64)
    place, group = stretches(ids, group, least)
    if not len(place):
        return none, none, none
    tree = SuffixTree(ids[place], group)
    left, right, period = covering(tree, group)
    _, one = np.unique(left * (tree.n + 1) + period, return_index=True)
    left, right, period = left[one], right[one], period[one]
    good = _primitive(tree, left, period)
    left, right, period = left[good], right[good], period[good]
    # The walk: the squares of a repeat are rotations of the first, one of each suffices.
    of, at = _ranges(left, np.minimum(right - left - 2 * period + 1, period))
    period = period[of]
    low, high = tree.loci(at, 2 * period)
    _, one = np.unique(low * (tree.n + 1) + period, return_index=True)
    of, leaf = _ranges(low[one], (high - low + 1)[one])
    found = np.sort(period[one][of] * (tree.n + 1) + tree.array[leaf])
    if not len(found):
        return none, none, none
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1] + 1
    first, last = found[new], found[np.append(new[1:], True)]
    period, start = first // (tree.n + 1), first % (tree.n + 1)
    length = last - first + 2 * period
    good = length >= least
    start, length, period = place[start[good]], length[good], period[good]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _worked(texts: list[bytes], least: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray | None]]:
    """Per text its words, its runs (rows of start, length, period) and which words stay (None: all)."""
    split = [text.split() for text in texts]
    words = [word for part in split for word in part]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    edges = np.concatenate(([0], np.cumsum(counts)))
    number = {word: k for k, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    start, length, period = find(ids, np.repeat(np.arange(len(split)), counts), least)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    stays = np.cumsum(gone)[:-1] == 0
    cuts = np.searchsorted(start, edges)
    for k, part in enumerate(split):
        mine = slice(cuts[k], cuts[k + 1])
        runs = np.column_stack((start[mine] - edges[k], length[mine], period[mine]))
        yield part, runs, stays[edges[k] : edges[k + 1]] if len(runs) else None


def find_runs(docs: DataFrame, *, text_column: str = "text", least: int = LEAST, texts: bool = True) -> DataFrame:
    """Adds ``runs`` (array of start, length, period by start, then period), ``n_words``, and ``collapsed``.

    ``collapsed``: the words joined by one space, without those that a run
    contains after its first ``period`` words. With ``texts`` false its place is
    taken by ``collapsed_sha256``, and the text column leaves, so nothing long
    comes back from the workers. No shuffle.
    """
    made = "collapsed" if texts else "collapsed_sha256"
    own = {"runs", "n_words", made}
    kept = [f for f in docs.schema.fields if f.name.lower() not in own and (texts or f.name.lower() != text_column.lower())]
    schema = T.StructType([*kept, T.StructField("runs", RUNS), T.StructField("n_words", T.LongType()), T.StructField(made, T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            bodies = utf8(column(batch, text_column))
            for first, part in blocks(bodies, RUN_BYTES):
                rows = {"runs": [], "n_words": [], made: []}
                for words, runs, stays in _worked(part, least):
                    text = b" ".join(words if stays is None else [w for w, stay in zip(words, stays.tolist(), strict=True) if stay])
                    rows["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
                    rows["n_words"].append(len(words))
                    rows[made].append(text.decode() if texts else hashlib.sha256(text).hexdigest())
                yield {n: column(batch, n).slice(first, len(part)) for n in names} | rows

    needed = docs if texts else docs.select(*names, F.col(text_column)) if text_column not in names else docs
    return map_rows(needed, schema, run)
