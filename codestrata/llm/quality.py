"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams of whitespace words, hashed into ``SLOTS``
slots: words and word pairs; words' last three bytes; runs of one to three word
shapes (case, digits, punctuation inside and at the end, and whether the word
repeats the one before, so that a stuck word is an n-gram like any other).
Indicators are scaled by the class log-count ratio, texts to unit length. A
linear model with hinge loss is fitted by dual coordinate descent and mixed with
the mean weight; out-of-fold margins fix the sigmoid that turns a margin into a
score.

The fit uses at most ``SAMPLE`` labelled rows, those with the least hash of the
id, so its cost does not grow with the corpus; the model is ``SLOTS`` numbers.
Only the text enters a score.

Defined cases: null and empty texts have no features and get the score of the
bias; rows with null labels are not learnt from; without rows of both classes
every score is the share of label 1 (0.5 without any row); rows are neither
merged nor dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.arrow import column, map_rows, utf8
from codestrata.llm.words import Words, blocks, mix

SLOTS = 1 << 18
SAMPLE = 8000
FOLDS = 5
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)  # 1 lower or beyond ASCII, 2 upper, 4 digit, 8 other
_CLASS[:] = 8
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 4


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from learning: CRC-32 of the id as text, modulo 5, is 0. A null id is not held out (nor learnt from: no label names it)."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's slots, ascending and without repeats."""
    out: list[np.ndarray] = []
    for _, part in blocks(texts):
        words = Words(part, lower=False)
        n = len(words.starts)
        if not n:
            out += [np.zeros(0, np.int32)] * len(part)
            continue
        h = words.hashes()
        text = np.repeat(np.arange(len(part)), words.counts)
        kinds = _CLASS[words.array]
        seen = np.bitwise_or.reduceat(kinds, words.starts) & np.where(True, np.uint8(15), 0)
        # The blank after the last word of each slice is in it: reduceat runs to the next start, blanks are "other".
        inner = np.add.reduceat((kinds == 8).astype(np.int32), words.starts) - 1
        upper = np.add.reduceat((kinds == 2).astype(np.int32), words.starts)
        size = words.ends - words.starts
        first, last = kinds[words.starts], kinds[words.ends - 1]
        same = np.zeros(n, np.uint64)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        seen = (seen & 7) | np.where(inner > 0, 8, 0).astype(np.uint8)
        shape = seen.astype(np.uint64) | first.astype(np.uint64) << np.uint64(4) | last.astype(np.uint64) << np.uint64(8) | np.minimum(inner, 3).astype(np.uint64) << np.uint64(12)
        shape |= (upper == size).astype(np.uint64) << np.uint64(16) | same << np.uint64(17) | (size == 1).astype(np.uint64) << np.uint64(18)
        end = np.zeros(n, np.uint64)
        for k in range(1, 4):
            at = words.ends - k
            end = end << np.uint64(8) | np.where(at >= words.starts, words.array[np.maximum(at, 0)], 0).astype(np.uint64)

        def run(values: np.ndarray, length: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
            """(text, hash) of every run of values inside one text."""
            m = n - length + 1
            if m <= 0:
                return np.zeros(0, np.int64), np.zeros(0, np.uint64)
            total = np.full(m, salt, np.uint64)
            for k in range(length):
                total = mix(total) + values[k : k + m]
            whole = text[:m] == text[length - 1 :]
            return text[:m][whole], mix(total)[whole]

        owners, hashes = zip(*(run(h, 1, 1), run(h, 2, 2), run(end, 1, 3), run(shape, 1, 4), run(shape, 2, 5), run(shape, 3, 6)), strict=True)
        slot = np.concatenate(owners).astype(np.int64) * SLOTS + (np.concatenate(hashes) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        slot = np.unique(slot)
        cuts = np.searchsorted(slot, np.arange(1, len(part)) * SLOTS)
        out += [(x % SLOTS).astype(np.int32) for x in np.split(slot, cuts)]
    return out


@dataclass
class Model:
    """``weights`` has one number a slot; a margin is their sum over a text's slots divided by its length in the scaled space."""

    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for k, row in enumerate(rows):
            length = np.sqrt(np.square(self.scale[row], dtype=np.float64).sum())
            out[k] = self.bias + (self.weights[row].sum(dtype=np.float64) / length if length else 0.0)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.offset, -40, 40)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(SLOTS, smooth), np.full(SLOTS, smooth)
    for row, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[row] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss (Hsieh et al. 2008): one dual variable a row, boxed to [0, cost]."""
    w, bias = np.zeros(SLOTS), 0.0
    alpha = np.zeros(len(rows))
    diagonal = np.array([v @ v + 1.0 for v in values])  # the bias is a feature of value 1
    random = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        most = 0.0
        for k in random.permutation(len(rows)):
            row, v, label = rows[k], values[k], y[k]
            gradient = label * (w[row] @ v + bias) - 1.0
            new = min(max(alpha[k] - gradient / diagonal[k], 0.0), cost[k])
            step = (new - alpha[k]) * label
            if step:
                w[row] += step * v
                bias += step
                alpha[k] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def fit_once(rows: list[np.ndarray], y: np.ndarray, cost: float, mixed: float, epochs: int) -> Model:
    ratio = log_count_ratio(rows, y)
    values = []
    for row in rows:
        v = ratio[row]
        length = np.sqrt(v @ v)
        values.append(v / length if length else v)
    share = np.array([(y > 0).mean(), (y < 0).mean()])
    weight = np.where(y > 0, 0.5 / share[0], 0.5 / share[1])
    w, bias = dual_descent(rows, values, y, cost * weight, epochs)
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    w = (1 - mixed) * mean * np.sign(w) + mixed * w
    return Model((w * ratio).astype(np.float32), ratio.astype(np.float32), float(bias), 1.0, 0.0)


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid by Newton steps, with his smoothed targets."""
    positive, negative = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, float(np.log((positive + 1) / (negative + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin + 1e-3 * (a - 1), d.sum()])
        m = np.array([[h @ (margin * margin) + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, mixed: float = 0.9, epochs: int = 12) -> Model:
    """The model of all rows; its sigmoid is fitted to margins of rows that the margin's model did not see."""
    y = np.where(labels > 0, 1, -1)
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = float((y > 0).mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if (y[train] > 0).all() or (y[train] < 0).all() or not len(test):
            continue
        margin[test] = fit_once([rows[i] for i in train], y[train], cost, mixed, epochs).margins([rows[i] for i in test])
    model = fit_once(rows, y, cost, mixed, epochs)
    model.slope, model.offset = sigmoid_fit(margin, y)
    return model


def train(docs: DataFrame, labels: DataFrame, *, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out fold, chosen by the id's hash.

    The chosen ids (a bounded table) are broadcast; their features are built on
    the executors, of an id's rows those with the least hash stay, and one task
    fits, so the driver gets the model alone.
    """
    chosen = (
        labels.select(labels[id_column].alias("i"), labels[label_column].cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(sample)
    )
    texts = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"))
    rows = texts.join(F.broadcast(chosen), "i").select("i", "y", "t")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield {"i": column(part, "i").cast(pa.string()), "y": column(part, "y"), "slots": [x.tobytes() for x in features(utf8(column(part, "t")))]}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found = []
        for batch in batches:
            found += zip(column(batch, "i").to_pylist(), column(batch, "y").to_pylist(), column(batch, "slots").to_pylist(), strict=True)
        found.sort(key=lambda r: (r[0], r[2]))  # whatever the order of arrival, one model
        model = fit([np.frombuffer(r[2], np.int32) for r in found], np.array([r[1] for r in found], np.int64))
        yield {"weights": [model.weights.tobytes()], "scale": [model.scale.tobytes()], "numbers": [[model.bias, model.slope, model.offset]]}

    built = map_rows(rows, "i string, y int, slots binary", build)
    one = built.groupBy("i").agg(F.min_by(F.struct("y", "slots"), F.xxhash64("slots")).alias("r")).select("i", "r.y", "r.slots")
    row = map_rows(one.repartition(1), "weights binary, scale binary, numbers array<double>", learn).first()
    if row is None:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(row["weights"], np.float32), np.frombuffer(row["scale"], np.float32), *row["numbers"])


def score(docs: DataFrame, model: Model, *, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """Adds the score (0 to 1, higher: label 1 likelier) to every row. Nothing is shuffled; the model is a broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.drop(score_column).schema.fields
    schema = T.StructType([*fields, T.StructField(score_column, T.DoubleType())])
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = shared.value.scores(features(utf8(column(part, text_column))))
                yield {n: column(part, n) for n in kept} | {score_column: scores}

    return map_rows(docs.drop(score_column), schema, run)
