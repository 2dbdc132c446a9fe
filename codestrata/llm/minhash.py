"""One-permutation MinHash with optimal densification and packed low-order bits.

A text's shingles (runs of ``SHINGLE`` words without ASCII white space, A-Z in
lower case; fewer words are one shingle) are hashed once. The hash's high bits
choose one of ``BINS`` bins, each bin keeps its least value. An empty bin takes
the value of the first filled bin in its own fixed random order of the bins, the
same for all texts; so all bins agree between two texts with the probability of
their likeness, and no bin depends on how far the next filled one is. Each bin
keeps ``LOW`` low-order bits of its value mixed with its number, packed. Two unlike values agree in these by
chance with probability 2^-LOW, which the likeness corrects.

Defined cases: ids are integers of any size (other types are refused). A text without words has the fingerprint of zeros and is like
nothing but another text without words (1). Null is the empty text. Equal texts
have equal fingerprints. The next document is the next row by (doc_id, nulls
last, text's hash); one row alone is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.arrow import column, map_rows
from codestrata.llm.words import Words, blocks, mix

BINS = 512
LOW = 4
SHINGLE = 5
#: Texts of about so many bytes are fingerprinted together.
RUN_BYTES = 2 << 20

_BIN_BITS = BINS.bit_length() - 1
_ORDER = np.argsort(np.random.Generator(np.random.PCG64(20170707)).random((BINS, BINS)), axis=1)
_BIN_SALT = np.random.Generator(np.random.PCG64(314159)).integers(0, 1 << 63, BINS, dtype=np.uint64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densify(bins: np.ndarray) -> np.ndarray:
    """Fills each row's empty bins; rows without any filled bin stay empty."""
    filled = bins != _EMPTY
    row, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = bins.copy()
    for attempt in range(BINS):
        if not len(row):
            break
        source = _ORDER[empty, attempt]
        hit = filled[row, source]
        out[row[hit], empty[hit]] = bins[row[hit], source[hit]]
        row, empty = row[~hit], empty[~hit]
    return out


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(packed fingerprints: uint8[n, BINS * LOW / 8], whether the text has words)."""
    packed = np.zeros((len(texts), BINS * LOW // 8), np.uint8)
    some = np.zeros(len(texts), bool)
    for first, part in blocks(texts):
        text, h = Words(part).shingle_hashes(SHINGLE)
        bins = np.full(len(part) * BINS, _EMPTY)
        at = text * BINS + (h >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        np.minimum.at(bins, at, h & np.uint64((1 << (64 - _BIN_BITS)) - 1))
        bins = bins.reshape(len(part), BINS)
        mine = (bins != _EMPTY).any(axis=1)
        # Mixed with the bin's number: a value that stands in many bins has other low bits in each, so chance agreements stay independent.
        low = (mix(densify(bins) + _BIN_SALT) & np.uint64((1 << LOW) - 1)).astype(np.uint8)
        low[~mine] = 0
        bits = (low[:, :, None] >> np.arange(LOW, dtype=np.uint8)) & 1
        packed[first : first + len(part)] = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
        some[first : first + len(part)] = mine
    return packed, some


def likeness(x: np.ndarray, y: np.ndarray, some_x: np.ndarray, some_y: np.ndarray) -> np.ndarray:
    """The estimated Jaccard likeness of rows: the share of agreeing bins, less what low bits give by chance."""
    diff = x ^ y
    unlike = np.zeros(len(x), np.int64)
    for k in range(8 // LOW):
        unlike += np.count_nonzero((diff >> np.uint8(k * LOW)) & np.uint8((1 << LOW) - 1), axis=1)
    chance = 2.0**-LOW
    like = np.clip(((1 - unlike / BINS) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_x & some_y, like, np.where(some_x == some_y, 1.0, 0.0))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text (or all)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Each row needs the one after it. Rows are dealt by ranges of the id, whose
    bounds are fixed once on the driver (a few hundred numbers), and the first
    row of each range also goes to the range before it, so every range is
    worked on alone, as a stream: the texts are shuffled once.
    """
    spark = docs.sparkSession
    ranges = min(65536, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if id_column != "i":
        rows = docs.select(docs[id_column].alias("i"), F.coalesce(docs[text_column], F.lit("")).alias("t"))
    else:
        rows = docs.select("i", F.coalesce(docs[text_column], F.lit("")).alias("t"))
    if not isinstance(docs.schema[id_column].dataType, T.IntegralType):
        raise ValueError(f"{id_column} must be an integer column: its ranges are numbers")
    kind = docs.schema[id_column].dataType.simpleString()
    found = rows.where("i is not null").selectExpr("cast(i as double) as x").approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(found, np.float64))

    def range_of(ids: pa.Array) -> np.ndarray:
        # Rounded on purpose: rounding keeps the order, and ranges only have to be in order.
        plain = pc.fill_null(pc.cast(ids, pa.float64(), safe=False), np.inf).to_numpy(zero_copy_only=False)
        return np.where(np.isinf(plain), len(bounds) + 1, np.searchsorted(bounds, plain, side="right")).astype(np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids = column(batch, "i")
            yield {"part": range_of(ids), "i": ids, "h": [xxhash.xxh64_intdigest(t) - (1 << 63) for t in column(batch, "t").to_pylist()]}

    # The least (id, hash) of each range: at most one row a range.
    heads = map_rows(rows, f"part int, i {kind}, h long", place).groupBy("part").agg(F.min(F.struct("i", "h")).alias("least")).orderBy("part").collect()
    first = {(r["least"]["i"], r["least"]["h"]): r["part"] for r in heads}
    parts = [r["part"] for r in heads]
    before = {p: parts[k - 1] for k, p in enumerate(parts)}  # the first range's head follows the last range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids, texts, part = column(piece, "i"), column(piece, "t"), range_of(column(piece, "i"))
                h = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts.to_pylist()]
                yield {"part": part, "guard": np.zeros(len(part), np.int32), "h": h, "i": ids, "t": texts}
                copy = [k for k, key in enumerate(zip(ids.to_pylist(), h, strict=True)) if key in first]
                if copy:
                    yield {"part": [before[int(part[k])] for k in copy], "guard": [1] * len(copy), "h": [h[k] for k in copy], "i": ids.take(pa.array(copy)), "t": texts.take(pa.array(copy))}

    dealt = map_rows(rows, f"part int, guard int, h long, i {kind}, t string", deal)
    ordered = dealt.repartitionById(len(bounds) + 2, F.col("part")).sortWithinPartitions("part", "guard", F.col("i").asc_nulls_last(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [column(batch, c) for c in ("part", "guard", "i", "t")]
            for at in range(batch.num_rows):
                row = tuple(c[at].as_py() for c in columns)
                held.append(row)
                size += len(row[3])
                if size > RUN_BYTES and len(held) > 1:
                    yield made(held)
                    held, size = [row], len(row[3])
        if held:
            yield made(held)

    def made(held: list[tuple]) -> dict:
        """All rows whose next row is here too; the guard rows themselves are the neighbour range's."""
        mine = [k for k in range(len(held) - 1) if held[k][0] == held[k + 1][0] and not held[k][1]]
        texts = [r[3].encode() for r in held]
        print_of, some = signatures(texts)
        changed = [edited(held[k][3], held[k + 1][3]) for k in mine]
        coded = [c.encode() for c in changed]
        edited_print, edited_some = signatures(coded)
        at = np.array(mine, np.int64)
        return {
            "i": [held[k][2] for k in mine],
            "n_chars": [len(held[k][3]) for k in mine],
            "edited_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
            "fingerprint": [print_of[k].tobytes().hex() for k in mine],
            "edited_fingerprint": [p.tobytes().hex() for p in edited_print],
            "near_edited": likeness(print_of[at], edited_print, some[at], edited_some),
            "near_next": likeness(print_of[at], print_of[at + 1], some[at], some[at + 1]),
        }

    out = map_rows(ordered, f"i {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", run)
    return out.withColumnRenamed("i", id_column)
