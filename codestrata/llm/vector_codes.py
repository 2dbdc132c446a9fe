"""Product codes of vectors, assigned by a vantage-point tree over each part position's entries.

Each component becomes the integer floor(1024 * x). Vectors are cut into ``PARTS``
equal consecutive parts; each position has a codebook, first that part of the
``ENTRIES`` smallest kept ids. A round assigns every part to its nearest entry
(squared distance, ties to the lower index) and moves each entry to the floor of
the mean of its parts; unused entries stay.

*Search.* A node of a tree holds one entry and, for both halves of the others,
the least and the greatest distance from it. A descent gives each part a first
bound; then all nodes are visited for the parts whose lower bound is not above
the best distance so far (not strictly: a tie may have a lower index). Radii and
bounds are rounded outwards by a share that exceeds what a square root can err,
and each entry met is compared by its integer distance, so results are exact.
Codebooks are bounded (``ENTRIES`` vectors), so trees are built on the driver
and travel with the tasks; a round returns one row of sums an entry.

Defined cases: a null vector, or one with null or non-finite components, is
dropped; so is one whose length is not that of the first kept id's, or has
fewer components than parts. Components left over after equal parts
(length mod ``PARTS``) are not coded. Null ids are kept and come last in the
order of ids; equal ids are ordered by their vectors. Components are refused
beyond 2**21 (after scaling), where squared distances of parts wider than 512 leave exact doubles.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.arrow import fresh, map_rows
from codestrata.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 21
#: Vectors that are worked on together.
BLOCK = 8192
#: What bounds are widened by: far more than a double's square root and sums err.
SLACK = 1e-9


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a component is beyond {LIMIT / SCALE:g}; scale the vectors down")
    return scaled.astype(np.int64)


class VantageTree:
    """Entries as a vantage-point tree in arrays; node 0 is the root."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.entry: list[int] = []
        self.inner: list[int] = []
        self.outer: list[int] = []
        self.bounds: list[tuple[float, float, float, float]] = []  # least and greatest distance of the inner half, then of the outer
        self.median: list[float] = []
        self._build(np.arange(len(entries)))
        self.points = entries.astype(np.float64)

    def _build(self, mine: np.ndarray) -> int:
        """The node of these entries; depth is logarithmic, since halves are equal."""
        node = len(self.entry)
        others = self.entries[mine] - self.entries[mine].mean(axis=0)
        pick = int(np.argmax(np.einsum("ij,ij->i", others, others)))  # a far one tells the others apart best
        vantage, rest = int(mine[pick]), np.delete(mine, pick)
        self.entry.append(vantage)
        self.inner.append(-1)
        self.outer.append(-1)
        self.bounds.append((0.0, 0.0, 0.0, 0.0))
        self.median.append(0.0)
        if len(rest):
            away = self.entries[rest] - self.entries[vantage]
            distance = np.sqrt(np.einsum("ij,ij->i", away, away).astype(np.float64))
            order = np.argsort(distance, kind="stable")
            half = (len(rest) + 1) // 2
            near, far = distance[order[:half]], distance[order[half:]]
            low, high = 1 - SLACK, 1 + SLACK
            self.bounds[node] = (near[0] * low, near[-1] * high, far[0] * low if len(far) else 0.0, far[-1] * high if len(far) else 0.0)
            self.median[node] = float(near[-1])
            self.inner[node] = self._build(rest[order[:half]])
            if len(far):
                self.outer[node] = self._build(rest[order[half:]])
        return node

    def _distance(self, points: np.ndarray, node: int) -> np.ndarray:
        """Squared distances: whole numbers below 2**53, so exact."""
        away = points - self.points[self.entry[node]]
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, ties to the lower one; squared distance) of each integer part."""
        points = parts.astype(np.float64)
        best = np.full(len(points), np.inf)
        index = np.full(len(points), len(self.entry), np.int64)

        def meet(of: np.ndarray, node: int) -> np.ndarray:
            squared, entry = self._distance(points[of], node), self.entry[node]
            closer = (squared < best[of]) | ((squared == best[of]) & (entry < index[of]))
            best[of[closer]] = squared[closer]
            index[of[closer]] = entry
            return np.sqrt(squared)

        waiting = [(0, np.arange(len(points)))]
        while waiting:  # the descent: into the half whose side of the median the part is on
            node, of = waiting.pop()
            if len(of):
                inside = meet(of, node) <= self.median[node]
                if self.outer[node] < 0:
                    inside[:] = True
                for child, mine in ((self.inner[node], of[inside]), (self.outer[node], of[~inside])):
                    if child >= 0 and len(mine):
                        waiting.append((child, mine))
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, of = waiting.pop()
            distance = meet(of, node)
            reach = np.sqrt(best[of]) * (1 + SLACK)
            for child, (low, high) in ((self.outer[node], self.bounds[node][2:]), (self.inner[node], self.bounds[node][:2])):
                if child >= 0:
                    least = np.maximum(distance * (1 - SLACK) - high, low - distance * (1 + SLACK))
                    mine = of[least <= reach]
                    if len(mine):
                        waiting.append((child, mine))
        return index, best.astype(np.int64)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _blocks(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, their integer vectors) of about BLOCK rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK:
            rows = pa.Table.from_batches(held).combine_chunks()
            held = []
            yield rows, integers(_matrix(rows.column(vector).combine_chunks()))
    if sum(map(len, held)):
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, integers(_matrix(rows.column(vector).combine_chunks()))


def _cut(whole: np.ndarray, parts: int) -> list[np.ndarray]:
    width = whole.shape[1] // parts
    return [whole[:, k * width : (k + 1) * width] for k in range(parts)]


def kept(vectors: DataFrame, vector_column: str) -> DataFrame:
    """The rows whose vector is whole and finite."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & finite)


def train(rows: DataFrame, *, id_column: str, vector_column: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """(codebooks of int64[entries, width] by part position, the vectors' length); no codebooks for no rows."""
    v = F.col(vector_column)
    first = rows.select(F.col(id_column).alias("i"), v.alias("v")).orderBy(F.col("i").asc_nulls_last(), F.col("v"))
    head = first.limit(1).collect()
    length = len(head[0]["v"]) if head else 0
    if length < parts:
        return [], length
    rows = rows.where(F.size(v) == length)
    start = integers(np.array([r["v"] for r in first.where(F.size("v") == length).limit(entries).collect()], np.float64))
    codebooks = _cut(start, parts)
    width = length // parts
    schema = "part int, entry int, count long, sums array<long>"
    for _ in range(rounds):
        trees = [VantageTree(book) for book in codebooks]

        def summed(batches: Iterator[pa.RecordBatch], trees: list[VantageTree] = trees) -> Iterator[dict]:
            count = np.zeros((parts, entries), np.int64)
            total = np.zeros((parts, entries, width), np.int64)
            for _, whole in _blocks(batches, "v"):
                for k, part in enumerate(_cut(whole, parts)):
                    index, _ = trees[k].nearest(part)
                    count[k] += np.bincount(index, minlength=entries)
                    np.add.at(total[k], index, part)
            part, entry = np.nonzero(count)
            yield {"part": part, "entry": entry, "count": count[part, entry], "sums": total[part, entry].tolist()}

        made = map_rows(rows.select(v.alias("v")), schema, summed)
        sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
        # One row an entry: bounded by the codebooks' size, whatever the table's.
        for r in made.groupBy("part", "entry").agg(F.sum("count").alias("count"), *sums).collect():
            codebooks[r["part"]][r["entry"]] = [r[f"s{k}"] // r["count"] for k in range(width)]
    return codebooks, length


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all final components by part, entry, position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, codebooks: list[np.ndarray], length: int, *, id_column: str, vector_column: str, label_column: str | None = None) -> DataFrame:
    """Per row its id, ``label`` where one is named, ``code`` (two hex digits a part) and ``error`` (squared distance)."""
    v = F.col(vector_column)
    trees = [VantageTree(book) for book in codebooks]
    chosen = [F.col(id_column).alias("i"), v.alias("v"), *([F.col(label_column).alias("label")] if label_column else [])]
    rows = rows.where(F.size(v) == length).select(chosen) if trees else rows.select(chosen).limit(0)
    fields = [f for f in rows.schema.fields if f.name != "v"]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table, whole in _blocks(batches, "v"):
            found = [tree.nearest(part) for tree, part in zip(trees, _cut(whole, len(trees)), strict=True)]
            codes = np.column_stack([index for index, _ in found]).astype(np.uint8)
            text = codes.tobytes().hex()
            step = 2 * len(trees)
            yield {f.name: table.column(f.name).combine_chunks() for f in fields} | {"code": [text[k : k + step] for k in range(0, len(text), step)], "error": sum(d for _, d in found)}

    return map_rows(rows, schema, run)


def compress(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per kept row: id, ``code``, ``error``, ``label_error`` (summed over equal labels, nulls together), ``codebooks_sha256``.

    The codes are written once; labels are summed before anything is shuffled,
    and the join of the sums is a plain one that adaptive execution splits where
    a label is hot (or broadcasts where the written sums are small).
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = kept(vectors, vector_column)
    codebooks, length = train(rows, id_column=id_column, vector_column=vector_column)
    coded = scratch.table(encode(rows, codebooks, length, id_column=id_column, vector_column=vector_column, label_column=label_column), "codes")
    sums = scratch.table(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    names = fresh(coded.select("code", "error").withColumn("label_error", F.lit(0)).withColumn("codebooks_sha256", F.lit("")), id_column)
    return joined.select(coded["i"].alias(names[0]), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
