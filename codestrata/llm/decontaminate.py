"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Items are indexed by length: those of up to 32 words, of up to 64, and so on, each
class with passages of its own. Every passage of every text is a query: windows of
twice the class's longest item, half a window apart, so that an item lies whole in
some window. Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower
case.

An item's score for a passage is the share of the item's own BM25 mass whose
terms the passage holds, so one threshold fits all items; document frequencies and
the mean length are those of all items, however these are dealt to indexes. Block-max
WAND finds every item at or above the threshold: a passage whose terms' greatest weights
sum to less, over all items and over each of ``RANGES`` ranges of items, is passed
over (for many passages at once, before any list is opened); then pivots are chosen by the lists' greatest weights, blocks are
skipped by their own, and the rest are scored whole. All bounds are upper
bounds, so nothing above the threshold is lost, and no number of hits is kept.

Verification. An item is a question and an answer: the last line if it has
several, else the last sentence, else the last quarter of its words. A hit
counts if the passage holds, in their order, at least ``OVERLAP`` of the question's
words and of the answer's (the longest common subsequence); of a part of two words
or more one word may always be missing.

An index of about ``ITEMS`` items is built on the driver and broadcast; longer lists
are searched in as many passes, one index after the other, each over all texts.
Nothing is shuffled but the passes' hits (and, in ``drop_contaminated``, the texts
where there are several passes).

Defined cases: null and empty texts hold nothing; items without words match
nothing; items equal in id and text are one, other repeated items are separate; rows
are neither merged nor dropped except, in ``drop_contaminated``, those that hold an item.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.arrow import column, map_rows, utf8
from codestrata.llm.scratch import Scratch
from codestrata.llm.words import PLAIN, Words, blocks

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
LEAST_STRIDE = 32
BLOCK = 4
RANGES = 64
ITEMS = 20_000
#: And at most so many bytes of items (or one longer item); more are searched in further passes.
ITEM_BYTES = 4 << 20
#: Pairs of a window and a term that are looked at together.
PAIRS = 1 << 18


def split_item(text: str) -> tuple[str, str]:
    """(question, answer)."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def in_order(part: np.ndarray, passage: np.ndarray) -> int:
    """How many of the part's words the passage holds in their order: the longest common subsequence, a bit a word."""
    at: dict[int, int] = {}
    for k, word in enumerate(part.tolist()):
        at[word] = at.get(word, 0) | 1 << k
    whole = (1 << len(part)) - 1
    free = whole
    for word in passage[np.isin(passage, part)].tolist():
        hit = free & at[word]
        free = (free + hit | free - hit) & whole
    return len(part) - free.bit_count()


def verified(part: np.ndarray, passage: np.ndarray) -> tuple[bool, float]:
    """Whether the passage holds the part, and the share of its words; an empty part is held."""
    n = len(part)
    if not n:
        return True, 1.0
    held = in_order(part, passage)
    return held >= n * OVERLAP - 1e-9 or n - held <= (n > 1), held / n


class Statistics(NamedTuple):
    """Of all items: how many have words, their mean length, in how many each term stands."""

    items: int
    mean: float
    terms: np.ndarray  # ascending hashes
    frequency: np.ndarray


def item_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Question and answer as word hashes."""
    question, answer = (Words([p.encode()], table=PLAIN).hashes() for p in split_item(text or ""))
    return question, answer


@dataclass
class Index:
    """Postings by term, items ascending, with weights normed to each item's own mass and greatest weights by block."""

    items: list[int]
    terms: np.ndarray  # ascending hashes
    greatest: np.ndarray  # by term
    postings: list[tuple[list[int], list[float], list[float]]]  # items, weights, greatest weight of each block
    parts: list[tuple[np.ndarray, np.ndarray]]  # question and answer as word hashes
    stride: int
    ranges: np.ndarray  # by term and range of items: the greatest weight
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # bits of the terms' low hash bits

    @classmethod
    def build(cls, rows: list[tuple[int, str]], statistics: Statistics | None = None) -> Index:
        return cls._build([(i, *item_words(t)) for i, t in rows], statistics)

    @classmethod
    def _build(cls, rows: list[tuple[int, np.ndarray, np.ndarray]], statistics: Statistics | None) -> Index:
        rows = [r for r in rows if len(r[1]) + len(r[2])]
        # Items of like length stand together: their weights are alike, so their ranges' and blocks' bounds are tight.
        rows.sort(key=lambda r: (len(r[1]) + len(r[2]), r[0] is None, r[0]))
        items, parts = [r[0] for r in rows], [(r[1], r[2]) for r in rows]
        bags = [np.concatenate(p) for p in parts]
        terms = np.unique(np.concatenate(bags)) if bags else np.zeros(0, np.uint64)
        of = statistics or statistics_of(bags)
        frequency = of.frequency[np.searchsorted(of.terms, terms)]
        counted = [np.unique(np.searchsorted(terms, bag), return_counts=True) for bag in bags]
        mean = of.mean
        idf = np.log(1 + (of.items - frequency + 0.5) / (frequency + 0.5))
        lists: list[tuple[list[int], list[float], list[float]]] = [([], [], []) for _ in terms]
        for item, (at, n) in enumerate(counted):
            weight = idf[at] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(bags[item]) / mean))
            for term, w in zip(at.tolist(), (weight / weight.sum()).tolist(), strict=True):
                lists[term][0].append(item)
                lists[term][1].append(w)
        for _, weights, tops in lists:
            tops += [max(weights[k : k + BLOCK]) for k in range(0, len(weights), BLOCK)]
        greatest = np.array([max(x[1]) for x in lists]) if lists else np.zeros(0)
        # The items in at most RANGES ranges of whole blocks: each term's greatest weight in each.
        step = BLOCK * max(1, -(-len(bags) // (BLOCK * RANGES)))
        ranges = np.zeros((len(terms), max(1, -(-len(bags) // step))), np.float32)
        for term, (ids, weights, _) in enumerate(lists):
            np.maximum.at(ranges[term], np.array(ids) // step, np.array(weights, np.float32) * np.float32(1 + 1e-6))
        known = np.zeros(1 << 20, bool)
        known[(terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return cls(items, terms, greatest, lists, parts, max([LEAST_STRIDE, *map(len, bags)]), ranges, known)

    def term_ids(self, h: np.ndarray) -> np.ndarray:
        """Each word's term, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.known[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]) if len(self.terms) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        same = self.terms[at] == h[maybe] if len(maybe) else np.zeros(0, bool)
        out[maybe[same]] = at[same]
        return out

    def promising(self, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(window, its terms) where some range of items could hold one at the threshold, for many windows at once."""
        size = end - start
        window = np.repeat(np.arange(len(size)), size)
        at = np.repeat(start, size) + np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
        pair = term[at]
        pair = np.unique(window[pair >= 0] * len(self.terms) + pair[pair >= 0])
        window, terms = pair // len(self.terms), pair % len(self.terms)
        edge = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1]))) if len(window) else window
        if not len(edge):
            return
        bound = np.add.reduceat(self.ranges[terms], edge, axis=0).max(axis=1)
        last = np.concatenate((edge[1:], [len(window)]))
        for k in np.flatnonzero(bound >= THRESHOLD - 1e-6):
            yield int(window[edge[k]]), terms[edge[k] : last[k]].tolist()

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item's place, score) of all items at or above the threshold: block-max WAND, document at a time."""
        threshold -= 1e-9
        cursors = [[0, self.postings[t], float(self.greatest[t])] for t in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[1][0][c[0]])
            total, pivot = 0.0, -1
            for k, (_, _, top) in enumerate(cursors):
                total += top
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][1][0][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][0][cursors[pivot + 1][0]] == item:
                pivot += 1
            # The blocks that would hold the pivot item.
            bound, following = 0.0, cursors[pivot + 1][1][0][cursors[pivot + 1][0]] if pivot + 1 < len(cursors) else 1 << 62
            for at, (ids, _, tops), _ in cursors[: pivot + 1]:
                block = bisect_left(ids, item, at) // BLOCK
                if block < len(tops):
                    bound += tops[block]
                    following = min(following, ids[min((block + 1) * BLOCK, len(ids)) - 1] + 1)
            if bound < threshold:
                target = max(following, item + 1)  # no item before it can reach the threshold
            elif cursors[0][1][0][cursors[0][0]] == item:
                score = sum(w[at] for at, (_, w, _), _ in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for cursor in cursors[: pivot + 1]:
                ids, at = cursor[1][0], cursor[0]
                cursor[0] = bisect_left(ids, target, at)
            cursors = [c for c in cursors if c[0] < len(c[1][0])]
        return found

    def found(self, words: Words, h: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item's place, score, question overlap, answer overlap) of the texts' verified passages."""
        term = self.term_ids(h)
        weight = np.where(term >= 0, self.greatest[term] if len(self.terms) else 0.0, 0.0)
        total = np.concatenate(([0.0], np.cumsum(weight)))
        # Windows: starts a stride apart inside each text.
        n = np.where(words.counts > 0, np.maximum(-(-(words.counts - self.stride) // self.stride), 1), 0)
        text = np.repeat(np.arange(len(n)), n)
        start = words.first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * self.stride
        end = np.minimum(start + 2 * self.stride, words.first[text + 1])
        open_ = np.flatnonzero(total[end] - total[start] >= THRESHOLD - 1e-9)
        together = max(1, min(2048, PAIRS // (2 * self.stride)))
        for run in range(0, len(open_), together):
            at = open_[run : run + together]
            for k, inside in self.promising(term, start[at], end[at]):
                span = slice(start[at[k]], end[at[k]])
                for item, score in self.search(inside):
                    (asked, question), (answered, answer) = (verified(p, h[span]) for p in self.parts[item])
                    if asked and answered:
                        yield int(text[at[k]]), item, score, question, answer


def statistics_of(bags: list[np.ndarray]) -> Statistics:
    each = [np.unique(b) for b in bags]
    terms, frequency = np.unique(np.concatenate(each), return_counts=True) if bags else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Statistics(len(bags), float(np.mean([len(b) for b in bags])) if bags else 1.0, terms, frequency)


def by_length(rows: list[tuple[int, str]], statistics: Statistics | None = None) -> list[Index]:
    """An index for each class of lengths."""
    made = [(i, *item_words(t)) for i, t in rows]
    made = [r for r in made if len(r[1]) + len(r[2])]
    of = statistics or statistics_of([np.concatenate(r[1:]) for r in made])
    classes: dict[int, list] = {}
    for row in made:
        classes.setdefault((max(len(row[1]) + len(row[2]), LEAST_STRIDE) - 1).bit_length(), []).append(row)
    return [Index._build(classes[k], of) for k in sorted(classes)]


def hits(indexes: list[Index], texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
    """(text, item id, score, question overlap, answer overlap): each text's verified items, best passage each."""
    best: dict[tuple[int, int, int], tuple[float, float, float]] = {}
    for first, part in blocks(texts):
        words = Words(part, table=PLAIN)
        h = words.hashes()
        for k, index in enumerate(indexes):
            for text, item, *values in index.found(words, h):
                key = (first + text, k, item)
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), tuple(values))
    return [(t, indexes[k].items[i], *v) for (t, k, i), v in sorted(best.items())]


def built(items: DataFrame, scratch: Scratch, *, id_column: str = "item_id", text_column: str = "text") -> list[Callable[[], list[Index]]]:
    """Builders of indexes of about ``ITEMS`` items and ``ITEM_BYTES`` bytes each, all with the statistics of the whole list."""
    rows = scratch.table(items.select(items[id_column].cast("long").alias("i"), items[text_column].alias("t")).distinct(), "items")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    if parts == 1:
        return [lambda: by_length([(r["i"], r["t"]) for r in rows.collect()])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            bags = [np.concatenate(item_words(t)) for t in column(batch, "t").to_pylist()]
            yield {"i": column(batch, "i"), "t": column(batch, "t"), "n": [len(b) for b in bags], "terms": [np.unique(b).view(np.int64) for b in bags]}

    deal = F.pmod(F.xxhash64("i", "t"), F.lit(parts)).alias("part")
    bags = scratch.table(map_rows(rows, "i long, t string, n long, terms array<long>", run).select("*", deal), "bags")
    whole = bags.where("n > 0").agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    terms = bags.select("part", F.explode("terms").alias("term"))
    frequency = scratch.table(terms.groupBy("term").agg(F.count("*").alias("n")), "frequency")

    def build(k: int) -> list[Index]:
        of = terms.where(F.col("part") == k).select("term").distinct().join(frequency, "term").toArrow()
        term, n = of.column("term").to_numpy().view(np.uint64), of.column("n").to_numpy()
        order = np.argsort(term)
        own = [(r["i"], r["t"]) for r in bags.where(F.col("part") == k).select("i", "t").collect()]
        return by_length(own, Statistics(whole["items"], whole["mean"] or 1.0, term[order], n[order]))

    return [lambda k=k: build(k) for k in range(parts)]


def _passes(spark: SparkSession, builders: list[Callable[[], list[Index]]], scratch: Scratch, made: Callable[[Broadcast], DataFrame]) -> list[DataFrame]:
    """``made`` of each index. Where there are several, each result is written, so that one index at a time is held."""
    out = []
    for k, build in enumerate(builders):
        shared = spark.sparkContext.broadcast(build())
        out.append(made(shared))
        if len(builders) > 1:
            out[k] = scratch.table(out[k], f"pass-{k}")
            shared.destroy()
    return out


def contaminated(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``): each text's items, one row a pair."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"))

    def search(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    found = hits(shared.value, utf8(column(part, "t")))
                    if found:
                        text, item, score, question, answer = (list(x) for x in zip(*found, strict=True))
                        yield {"i": column(part, "i").take(pa.array(text)), "item_id": item, "score": score, "question_overlap": question, "answer_overlap": answer}

        return map_rows(rows, f"i {kind}, item_id long, score double, question_overlap double, answer_overlap double", run)

    scratch = Scratch(docs.sparkSession, "leaks")
    return reduce(DataFrame.unionByName, _passes(docs.sparkSession, built(items, scratch), scratch, search)).withColumnRenamed("i", id_column)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts hold no item.

    A single index drops rows as they pass; several name the texts that hold
    items by digest, and an anti-join drops the rows.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    builders = built(items, scratch)

    def held(part: pa.RecordBatch, name: str, shared: Broadcast) -> pa.Array:
        """Which rows' texts hold an item."""
        out = np.zeros(part.num_rows, bool)
        out[[h[0] for h in hits(shared.value, utf8(column(part, name)))]] = True
        return pa.array(out)

    def clean(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    keep = pc.invert(held(part, text_column, shared))
                    yield {c: column(part, c).filter(keep) for c in part.schema.names}

        return map_rows(docs, docs.schema, run)

    def digests(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    yield {"digest": column(part, "digest").filter(held(part, "t", shared))}

        return map_rows(docs.select(docs[text_column].alias("t"), F.sha2(docs[text_column], 256).alias("digest")), "digest string", run)

    if len(builders) == 1:
        return _passes(docs.sparkSession, builders, scratch, clean)[0]
    found = reduce(DataFrame.unionByName, _passes(docs.sparkSession, builders, scratch, digests)).distinct()
    return docs.join(found, F.sha2(docs[text_column], 256) == found["digest"], "left_anti")
