"""Near-duplicate lines by a deletion-neighbourhood join; the earliest stays.

A line is what line feeds part, as its words (runs without ASCII white space,
A-Z in lower case). Two lines are duplicates if they are equal or if at most
one word is inserted, deleted or replaced between them and the longer has
``least_words`` words or more (5: so that at least four of five words agree).
A line goes if a duplicate stands earlier: in a row with a smaller id, or
further up in the same row.

The join. Two lines are within one edit exactly if they share a deletion variant:
both with the same word deleted (a replacement), or one as it is and the other
with a word deleted. So each distinct line emits all its variants as hashed keys,
each key learns the earliest line that files it (a pre-aggregated minimum, never a
list), and a line has an earlier duplicate if a key that it reads has one.
Nothing is paired, so one line or one template in a third of all rows costs no
more than others.

Pruning. The variants of a line are as many as its words, so lines whose
neighbourhood is empty are told apart first: an edit leaves one half of a line
whole, and only lines that share a half with a different line file variants. A
bit array of bounded size (``MAX_BITS``) of the shared halves lets few other lines'
texts travel; the join that follows is exact, so a full array costs one more
shuffle of the texts and neither results nor more variants. Variants are filed
as bare keys first; only those that two lines share are filed with places.

Verification. The words of both lines are compared; only pairs at one edit count.
Equal lines are equal in 96 hash bits of their words.

Defined cases: ids are integers; null ids come last; null text stays null and has no
lines; blank lines stay; rows are neither merged nor dropped; lines that share
id and line number (repeated rows) are one place, so repeated rows are treated
alike; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.arrow import column, fresh, map_rows, utf8
from codestrata.llm.scratch import Scratch
from codestrata.llm.words import LOWER, Words, blocks, mix

LEAST_WORDS = 5
MAX_BITS = 1 << 26
_BASES = (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)
_LENGTH = np.uint64(0xE7037ED1A0B428DB)
_REPLACED, _HALF = np.uint64(0x589965CC75374CC3), np.uint64(0x8EBC6AF09C88C6E3)
_PLACE = "decimal(31,0)"


_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n + 1`` powers of the base and of its inverse modulo 2**64."""
    if base not in _known or len(_known[base][0]) <= n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(max(n + 1, 1 << 18), b, np.uint64)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        _known[base] = (out[0], out[1])
    return _known[base]


class Lines:
    """The lines of a block of texts with their hashes and, on demand, their neighbourhoods."""

    def __init__(self, texts: list[bytes]):
        split = [t.split(b"\n") for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        self.text = np.repeat(np.arange(len(texts)), n)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        self.lines = [line for lines in split for line in lines]
        words = Words(self.lines)
        self.first, self.count = words.first[:-1], words.counts
        self.word = words.hashes()
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sums(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the words' hashes times powers of a base, and the powers of its inverse."""
        if which not in self._sums:
            power, inverse = _powers(_BASES[which], len(self.word))
            total = np.zeros(len(self.word) + 1, np.uint64)
            np.cumsum(self.word * power[: len(self.word)], out=total[1:])
            self._sums[which] = (total, inverse)
        return self._sums[which]

    def whole(self, which: int) -> np.ndarray:
        """One of each line's two hashes."""
        total, inverse = self.sums(which)
        poly = (total[self.first + self.count] - total[self.first]) * inverse[self.first]
        return mix(poly + self.count.astype(np.uint64) * _LENGTH)

    def variants(self, lines: np.ndarray, second: bool = True) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(line, position, one or two hashes) of each line with one word deleted."""
        n = self.count[lines]
        line = np.repeat(lines, n)
        position = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        start = self.first[line]
        at, end = start + position, start + self.count[line]
        out = []
        for total, inverse in [self.sums(0), self.sums(1)][: 1 + second]:
            head = (total[at] - total[start]) * inverse[start]
            tail = (total[end] - total[at + 1]) * inverse[start] * inverse[1]
            out.append(mix(head + tail + (self.count[line] - 1).astype(np.uint64) * _LENGTH))
        return line, position, out

    def half_keys(self, lines: np.ndarray) -> np.ndarray:
        """Per line four keys: its halves, as the shorter and as the longer of two lines; one edit leaves one half whole."""
        total, inverse = self.sums(0)
        keys = []
        start, count = self.first[lines], self.count[lines]
        for less in (0, 1):
            short = count - less
            half = short // 2
            for tail, (a, b) in enumerate(((start, start + half), (start + count - (short - half), start + count))):
                size = (short * 2 + tail).astype(np.uint64)
                keys.append(mix((total[b] - total[a]) * inverse[a] + mix(size + _HALF)))
        return np.stack(keys, axis=1)

    def distinct(self, lines: np.ndarray) -> np.ndarray:
        """The first of each set of equal lines; a block's repeats emit once."""
        return lines[np.unique(self.whole(0)[lines], return_index=True)[1]]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few texts twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bit_array(keys: DataFrame) -> np.ndarray:
    """The keys' bits, 64 a word; its size is the least power of two with 32 bits a key, within the bound."""
    n = keys.count()
    bits = min(MAX_BITS, 1 << max(12, (32 * n).bit_length()))
    at = keys.select(F.explode(F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return out


def _hits(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys a bit array accepts."""
    mask = np.uint64(len(bits) * 64 - 1)
    at = key & mask
    found = bits[at >> np.uint64(6)] >> (at & np.uint64(63))
    at = (key >> np.uint64(32)) & mask
    return (found & (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)) == 1


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """One list of keys for each row; null for rows that own none. ``owner`` ascends, each owner has one row of ``values``."""
    width = values.shape[1]
    has = np.zeros(rows, bool)
    has[owner] = True
    offsets = np.concatenate(([0], np.cumsum(has * width))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).view(np.int64)), type=pa.list_(pa.field("element", pa.int64())), mask=pa.array(~has))


def _place(i: Column, line: Column) -> Column:
    """A place as a number: by id, null last, then by line."""
    number = F.coalesce(i.cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)"))
    return (number * F.lit(1 << 31).cast("decimal(10,0)") + line).cast(_PLACE)


def _occurrences(rows: DataFrame, least: int) -> DataFrame:
    """(g, c: a line's hashes; i, row, line: where it stands; halves: keys, once a block and line) of every line with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches):
            ids, row = column(batch, "i"), column(batch, "row").to_numpy(zero_copy_only=False)
            for first, part in blocks(utf8(column(batch, "t"))):
                lines = Lines(part)
                own = np.flatnonzero(lines.count > 0)
                g, c = lines.whole(0), lines.whole(1)
                emits = np.sort(lines.distinct(np.flatnonzero(lines.count >= least - 1)))
                text = lines.text[own] + first
                yield {
                    "g": g[own].view(np.int64),
                    "c": (c[own] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    "i": ids.take(pa.array(text)),
                    "row": row[text],
                    "line": lines.number[own].astype(np.int32),
                    "halves": _lists(lines.half_keys(emits), np.searchsorted(own, emits), len(own)),
                }

    return map_rows(rows, "g long, c int, i long, row long, line int, halves array<long>", run)


def _texts(rows: DataFrame, halves: np.ndarray, least: int) -> DataFrame:
    """(g, c, text, halves) of the lines with a half in the bit array, once a block and line."""
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches):
            for _, part in blocks(utf8(column(batch, "t"))):
                lines = Lines(part)
                some = lines.distinct(np.flatnonzero(lines.count >= least - 1))
                keys = lines.half_keys(some)
                hit = _hits(keys, shared.value).any(axis=1)
                some, keys = some[hit], keys[hit]
                yield {
                    "g": lines.whole(0)[some].view(np.int64),
                    "c": (lines.whole(1)[some] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    "text": pa.array([lines.lines[k] for k in some], pa.binary()).cast(pa.string()),
                    "halves": _lists(keys, np.arange(len(some)), len(some)),
                }

    return map_rows(rows.select("t"), "g long, c int, text string, halves array<long>", run)


def _blocks_of(near: DataFrame, schema: str, made: Callable[[Lines, pa.RecordBatch], dict]) -> DataFrame:
    """``made`` of the blocks of a table of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches, 2048):
            at = 0
            for _, part in blocks(utf8(column(batch, "text"))):
                yield made(Lines(part), batch.slice(at, len(part)))
                at += len(part)

    return map_rows(near, schema, run)


def _shared_variants(near: DataFrame, least: int) -> DataFrame:
    """Keys (a line as it is, or without one word) that two different lines have."""

    def made(lines: Lines, _: pa.RecordBatch) -> dict:
        g = lines.whole(0)
        line, _, (key,) = lines.variants(np.flatnonzero(lines.count >= least), second=False)
        return {"key": np.concatenate((g, key)).view(np.int64), "h": np.concatenate((g, g[line])).view(np.int64)}

    keyed = _blocks_of(near.select("text"), "key long, h long", made)
    return keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")


def _filed(near: DataFrame, keys: np.ndarray, least: int) -> DataFrame:
    """(k, kc: a key; deleted: a word is missing from it; g, c, place: the line that files it) of the keys that a bit array accepts."""
    shared = near.sparkSession.sparkContext.broadcast(keys)

    def made(lines: Lines, batch: pa.RecordBatch) -> dict:
        g, c = lines.whole(0), lines.whole(1)
        own = np.flatnonzero(_hits(g, shared.value))
        where, position, (vg, vc) = lines.variants(np.flatnonzero(lines.count >= least))
        hit = _hits(vg, shared.value)
        where, position, vg, vc = where[hit], position[hit], vg[hit], vc[hit]
        replaced = mix((vg ^ _REPLACED) + position.astype(np.uint64))
        line = np.concatenate((own, where, where))
        deleted = np.zeros(len(line), bool)
        deleted[len(own) : len(own) + len(where)] = True
        take = pa.array(line)
        return {
            "k": np.concatenate((g[own], vg, replaced)).view(np.int64),
            "kc": (np.concatenate((c[own], vc, vc)) >> np.uint64(32)).astype(np.uint32).view(np.int32),
            "deleted": deleted,
            **{x: column(batch, x).take(take) for x in ("g", "c", "place")},
        }

    return _blocks_of(near, f"k long, kc int, deleted boolean, g long, c int, place {_PLACE}", made)


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word is inserted, deleted or replaced between two lists."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _verified(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs whose words are at one edit."""
    for end in ("", "o"):
        pairs = pairs.join(near.select(F.col("g").alias(f"{end}g"), F.col("c").alias(f"{end}c"), F.col("text").alias(f"{end}text")), [f"{end}g", f"{end}c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches, 2048):
            both = (([w for w in x.translate(LOWER).split(b" ") if w] for x in utf8(column(batch, name))) for name in ("text", "otext"))
            ok = pa.array([one_edit(a, b) for a, b in zip(*both, strict=True)], pa.bool_())
            yield {x: column(batch, x).filter(ok) for x in ("g", "c", "before")}

    return map_rows(pairs, f"g long, c int, before {_PLACE}", run)


def duplicate_lines(docs: DataFrame, scratch: Scratch, *, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(i, row, lines): for each row that loses lines its id, the hash of id and text, and the lines' numbers from 0."""
    i = docs[id_column].cast("long")
    rows = docs.select(i.alias("i"), docs[text_column].alias("t"), F.xxhash64(i, docs[text_column]).alias("row"))
    lines = scratch.table(_occurrences(rows, least_words), "lines")
    halves = lines.select(F.explode("halves").alias("key"), F.col("g").alias("h"))
    halves = scratch.table(halves.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key"), "halves")
    # Distinct lines that share a half with another, with their earliest places.
    texts = scratch.table(_texts(rows, _bit_array(halves), least_words).dropDuplicates(["g", "c"]), "texts")
    meets = texts.select("g", "c", F.explode("halves").alias("key")).join(halves, "key", "left_semi").select("g", "c").distinct()
    place = _place(F.col("i"), F.col("line"))
    classes = scratch.table(lines.groupBy("g", "c").agg(F.min(place).alias("place"), F.max(place).alias("last")), "classes")
    near = texts.select("g", "c", "text").join(meets, ["g", "c"]).join(classes.select("g", "c", "place"), ["g", "c"])
    near = scratch.table(near, "near")
    keys = _bit_array(scratch.table(_shared_variants(near, least_words), "keys"))
    filed = scratch.table(_filed(near, keys, least_words), "filed")
    # The earliest line of a key as a whole line (or replacement) and as a line without one word. Written first, so the join can be split.
    line = F.struct("place", "g", "c")
    earliest = filed.groupBy("k", "kc").agg(F.min(F.when(~F.col("deleted"), line)).alias("as_is"), F.min(F.when(F.col("deleted"), line)).alias("without"))
    earliest = scratch.table(earliest, "earliest")
    found = F.array(F.col("as_is"), F.when(~F.col("deleted"), F.col("without")))
    pairs = filed.join(earliest, ["k", "kc"]).select("g", "c", "place", F.explode(found).alias("o")).where(F.col("o.place") < F.col("place"))
    pairs = pairs.select("g", "c", F.col("o.g").alias("og"), F.col("o.c").alias("oc"), F.col("o.place").alias("before")).distinct()
    before = _verified(scratch.table(pairs, "pairs"), near).groupBy("g", "c").agg(F.min("before").alias("before"))
    # Of each line what stands after its own first place, or all of it if a near line is earlier.
    going = classes.join(scratch.table(before, "before"), ["g", "c"], "left").where(F.col("before").isNotNull() | (F.col("place") < F.col("last")))
    going = scratch.table(going.select("g", "c", F.least("place", "before").alias("stays")), "going")
    gone = lines.select("g", "c", "i", "row", "line").join(going, ["g", "c"]).where(place > F.col("stays"))
    return gone.groupBy("i", "row").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", before_column: str = "lines_in", after_column: str = "lines_out", least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns, the text without its duplicate lines, and the numbers of lines before and after."""
    scratch = Scratch(docs.sparkSession, "lines")
    drops = duplicate_lines(docs, scratch, id_column=id_column, text_column=text_column, least_words=least_words)
    base = docs.drop(before_column, after_column)
    row, number, none, gone_column = fresh(base, "row", "i", "none", "gone")
    drops = drops.select(F.col("row").alias(row), F.coalesce("i", F.lit(0)).alias(number), F.col("i").isNull().alias(none), F.col("lines").alias(gone_column))
    i = docs[id_column].cast("long")
    keyed = base.withColumns({row: F.xxhash64(i, docs[text_column]), number: F.coalesce(i, F.lit(0)), none: i.isNull()})
    joined = keyed.join(drops, [row, number, none], "left").drop(row, number, none)
    kept = [c for c in base.columns if c != text_column]
    schema = T.StructType([*base.schema.fields, T.StructField(before_column, T.IntegerType()), T.StructField(after_column, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in _slices(batches):
            texts, before, after = [], [], []
            for text, gone in zip(column(part, text_column).to_pylist(), column(part, gone_column).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                before.append(len(lines))
                if gone:
                    out = set(gone)
                    lines = [x for k, x in enumerate(lines) if k not in out]
                    text = "\n".join(lines)
                after.append(len(lines))
                texts.append(text)
            yield {c: column(part, c) for c in kept} | {text_column: texts, before_column: before, after_column: after}

    return map_rows(joined, schema, run)
