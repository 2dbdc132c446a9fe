"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

Fingerprint. Words are the runs without ASCII white space of the whole text, A-Z
in lower case. A bit is 1 if it is set in over half of the XXH64 values (seed
42) of the shingles of ``width`` words, repeats included; fewer words are one
shingle; no words give 0.

Candidates. 64 bits are ``SEGMENTS`` segments in a ring, one more than the
distance bound. By the pigeonring principle two fingerprints within the bound
have a segment from which every chain of consecutive segments keeps its
cumulative difference within its share of the bound: 0 in the first segment, at
most 1 in the first two, at most 2 in the first three. A chain's first segments are
hashed. With two, a fingerprint is filed under its own and under those whose
second segment differs in one bit that is 0 in it (the other of such a pair has a 1
there and files its own), so both meet under one key of about 26 bits. Of more than
``MANY`` fingerprints too many would share such keys: then the first three are
hashed, 39 bits, and filed as they are and with any one bit of the second and third
changed, so that two that differ in two bits there meet. Members of a key's group
are pruned by the longer chains, then by the full distance. Either way no pair is
lost.

Groups. A key's group is read as a sorted stream and only a spanning forest of
its links is emitted: breadth-first, so a dense group of g fingerprints costs
about g comparisons of vectors, not g^2 rows. Groups over ``GROUP`` members are
dealt in blocks; every pair of blocks is one bounded sub-group, so no pair is
lost and no task holds an unbounded group. Exact copies are one fingerprint
from the start.

Components. Star contraction (large star, small star) on the forest's edges,
each round a written table in the shared folder.

Defined cases: null is the empty text (fingerprint 0, linked like any other);
rows are neither merged nor dropped; rows with a null id keep their fingerprint
and get the smallest id of their component, null only if no member has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.arrow import column, fresh, map_rows, utf8
from codestrata.llm.scratch import Scratch
from codestrata.llm.words import Words, blocks

BITS = 64
DISTANCE = 4
SEGMENTS = DISTANCE + 1
#: First bit and width of each segment: 13, 13, 13, 13, 12.
WIDTHS = [BITS // SEGMENTS + (k < BITS % SEGMENTS) for k in range(SEGMENTS)]
FIRST = [sum(WIDTHS[:k]) for k in range(SEGMENTS)]
GROUP = 4096
#: Places in a key: a segment's bits, the ring position, a block's number.
_WIDEST, _START, _BLOCK = max(WIDTHS), 3 * max(WIDTHS), 3 * max(WIDTHS) + 3
#: Fingerprints from which keys are of three segments: some thirty share a key of two.
MANY = 1 << 28

_BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def fingerprints(texts: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """The texts' fingerprints as unsigned 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, part in blocks(texts):
        words = Words(part)
        text, head, tail = words.shingles(width)
        if not len(text):
            continue
        data = words.data
        at, to = words.starts[head].tolist(), words.ends[tail].tolist()
        h = np.fromiter([digest(data[s:e], seed) for s, e in zip(at, to, strict=True)], np.uint64, len(at))
        n = np.bincount(text, minlength=len(part))
        octets = h.view(np.uint8).reshape(-1, 8)
        fp = np.zeros(len(part), np.uint64)
        for k in range(8):  # little-endian: byte k holds bits 8k to 8k+7
            counts = np.bincount(text * 256 + octets[:, k], minlength=len(part) * 256).reshape(len(part), 256)
            ones = counts @ _BIT_TABLE
            set_bits = (2 * ones > n[:, None]).astype(np.uint64)
            fp |= (set_bits << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        out[first : first + len(part)] = fp
    return out


def with_fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """(``i``: the id, ``row``: a hash of id and text, ``fp`` bigint: the fingerprint's 64 bits) for every row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield {"i": column(part, "i"), "row": column(part, "row"), "fp": fingerprints(utf8(column(part, "t")), width).view(np.int64)}

    rows = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"), F.xxhash64(docs[id_column], docs[text_column]).alias("row"))
    return map_rows(rows, f"i {kind}, row long, fp long", run)


def chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """For a ring position: the bits of its chain of each length and the chain's budget."""
    mask, out = 0, []
    for length in range(1, SEGMENTS + 1):
        k = (start + length - 1) % SEGMENTS
        mask |= ((1 << WIDTHS[k]) - 1) << FIRST[k]
        out.append((np.uint64(mask), length * DISTANCE // SEGMENTS))
    return out


CHAINS = [chain_masks(s) for s in range(SEGMENTS)]


def chain_keys(fp: np.ndarray, length: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into ``fp``): the first ``length`` segments of each chain, as they are and with one bit changed.

    Of two segments only a 0 of the second changes; of three any bit of the second and third.
    """
    keys, index = [], []
    own = np.arange(len(fp))
    for start in range(SEGMENTS):
        base = np.full(len(fp), start, np.uint64) << np.uint64(_START)
        for at, k in enumerate((start + j) % SEGMENTS for j in range(length)):
            base |= ((fp >> np.uint64(FIRST[k])) & np.uint64((1 << WIDTHS[k]) - 1)) << np.uint64(_WIDEST * at)
        keys.append(base)
        index.append(own)
        for at in range(1, length):
            for bit in range(WIDTHS[(start + at) % SEGMENTS]):
                flag = np.uint64(1 << (_WIDEST * at + bit))
                free = np.flatnonzero(base & flag == 0) if length == 2 else own
                keys.append(base[free] ^ flag)
                index.append(free)
    return np.concatenate(keys), np.concatenate(index)


def linked(x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
    """Which pairs keep every chain from ``start`` within its budget; the longest chain is the whole distance."""
    diff = x ^ y
    ok = np.bitwise_count(diff & CHAINS[start][2][0]) <= CHAINS[start][2][1]
    for mask, budget in CHAINS[start][3:]:
        ok &= np.bitwise_count(diff & mask) <= budget
    return ok


def forest(fp: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """A spanning forest of a group's links, breadth-first."""
    left = np.unique(fp)
    out_a: list[int] = []
    out_b: list[int] = []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        at = queue.pop()
        hit = linked(at, left, start)
        if hit.any():
            found = left[hit]
            out_a += [int(at)] * len(found)
            out_b += found.tolist()
            queue += list(found)
            left = left[~hit]
    return out_a, out_b


def group_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups, rows sorted by key: small groups by shifted comparison, larger ones as forests."""
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((edge, [len(key)])))
    starts = ((key >> np.uint64(_START)) & np.uint64(7)).astype(np.int64)
    out_a, out_b = [], []
    small = np.repeat(size <= 8, size)
    for shift in range(1, 8):
        if len(key) <= shift:
            break
        pair = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
        if not len(pair):
            break
        x, y, s = fp[pair], fp[pair + shift], starts[pair]
        for start in range(SEGMENTS):
            here = s == start
            a, b = x[here], y[here]
            ok = linked(a, b, start) & (a != b)
            out_a.append(a[ok])
            out_b.append(b[ok])
    for k in np.flatnonzero(size > 8):
        part = slice(edge[k], edge[k] + size[k])
        a, b = forest(fp[part], int(starts[edge[k]]))
        out_a.append(np.array(a, np.uint64))
        out_b.append(np.array(b, np.uint64))
    return np.concatenate(out_a) if out_a else np.zeros(0, np.uint64), np.concatenate(out_b) if out_b else np.zeros(0, np.uint64)


def hamming_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links that span every component of distinct ``fp`` values within the distance bound."""
    length = 2 if fps.count() <= MANY else 3

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fp = column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 2048):
                key, index = chain_keys(fp[at : at + 2048], length)
                yield {"key": key.view(np.int64), "fp": fp[at : at + 2048][index].view(np.int64)}

    keyed = map_rows(fps.select("fp"), "key long, fp long", expand)
    # Written first: its size is then known, and the join below is planned by it (most often it is empty).
    large = scratch.table(keyed.groupBy("key").count().where(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / (GROUP / 2)).cast("int").alias("parts")), "large")
    # A large group is dealt in blocks; a member goes to every pair of blocks that holds its own.
    dealt = keyed.join(large, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    block = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, own) * F.col("parts") + F.greatest(x, own)))
    dealt = dealt.select("key", F.explode(block).alias("block"), "fp")
    sorted_groups = dealt.repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            now = [
                column(batch, "key").to_numpy(zero_copy_only=False).view(np.uint64),
                column(batch, "block").to_numpy(zero_copy_only=False).astype(np.int64),
                column(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64),
            ]
            key, blk, fp = (np.concatenate(x) for x in zip(held, now, strict=True))
            # All but the last group are whole.
            cut = len(key)
            while cut and key[cut - 1] == key[-1] and blk[cut - 1] == blk[-1]:
                cut = max(cut - 64, 0) if cut > 64 and key[cut - 64] == key[-1] and blk[cut - 64] == blk[-1] else cut - 1
            held = [key[cut:], blk[cut:], fp[cut:]]
            yield made(key[:cut], blk[:cut], fp[:cut])
        yield made(*held)

    def made(key: np.ndarray, blk: np.ndarray, fp: np.ndarray) -> dict:
        # A block's number tells equal keys' blocks apart.
        a, b = group_links(key | (blk.astype(np.uint64) << np.uint64(_BLOCK)), fp)
        low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        return {"a": low, "b": high}

    return map_rows(sorted_groups, "a long, b long", link).distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by large-star and small-star rounds.

    Each half round is a pre-aggregated minimum per node and one join; both
    are written first, so adaptive execution can split the join at a hub.
    """
    last = "edges-0"
    edges = scratch.table(edges.where("a <> b"), last)
    before = None
    for k in range(max_rounds):
        for half in ("large", "small"):
            if half == "large":
                both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            else:
                both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            lowest = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"lowest-{half}-{k}")
            joined = both.join(lowest, "a")
            if half == "large":
                pairs = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:
                pairs = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.where("a <> m").select("a", F.col("m").alias("b")))
            edges = scratch.table(pairs.where("a <> b").distinct(), f"edges-{half}-{k}")
            for read in (last, f"lowest-{half}-{k}"):  # no plan reads them any more
                scratch.drop(read)
            last = f"edges-{half}-{k}"
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"the components are not stable after {max_rounds} rounds")


def _named(docs: DataFrame, scratch: Scratch, id_column: str, text_column: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(every row's fingerprint; every fingerprint's ``root`` and ``component_id``), both written."""
    prints = scratch.table(with_fingerprints(docs, id_column=id_column, text_column=text_column, width=width), "fingerprints")
    classes = scratch.table(prints.groupBy("fp").agg(F.min("i").alias("first")), "classes")
    rooted = components(hamming_links(classes, scratch), scratch)
    members = classes.join(rooted, classes["fp"] == rooted["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    members = scratch.table(members, "members")
    lowest = scratch.table(members.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    return prints, scratch.table(members.join(lowest, "root").select("fp", "root", "component_id"), "named")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """(id, ``fingerprint`` of 16 hex digits, ``component_id``: the smallest id reachable over links) per row."""
    prints, named = _named(docs, Scratch(docs.sparkSession, "simhash"), id_column, text_column, width)
    return prints.join(named, "fp").select(F.col("i").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """The rows, with all their columns, that stay: of each component the one with the smallest id (null last; ties: by the text's hash)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints, named = _named(docs, scratch, id_column, text_column, width)
    return keep_one(docs, prints, named, scratch, id_column=id_column, text_column=text_column)


def keep_one(docs: DataFrame, prints: DataFrame, named: DataFrame, scratch: Scratch, *, id_column: str, text_column: str) -> DataFrame:
    """The rows that stay; ``prints``: (i, row, fp) of every row, ``named``: (fp, root).

    Of rows equal in id and text, but not in other columns, the one with the least hash of its columns stays.
    """
    i, none, row, n = fresh(docs, "i", "none", "row", "n")
    place = F.struct(F.col("i").isNull().alias("none"), F.col("i").alias("i"), F.col("row").alias("row"))
    # Equal rows are one place; how often it stands is counted, so that one of them stays.
    places = scratch.table(prints.groupBy("fp", "i", "row").agg(F.count("*").alias("n")).join(named.select("fp", "root"), "fp"), "places")
    stay = places.groupBy("root").agg(F.min(F.struct(place.alias("place"), F.col("n"))).alias("s"))
    stay = scratch.table(stay.select(F.coalesce(F.col("s.place.i"), F.lit(0)).alias(i), F.col("s.place.none").alias(none), F.col("s.place.row").alias(row), F.col("s.n").alias(n)), "stay")
    own = docs[id_column]
    keyed = docs.withColumns({i: F.coalesce(own, F.lit(0)), none: own.isNull(), row: F.xxhash64(own, docs[text_column])})
    keys = [i, none, row]
    kept = keyed.join(stay, keys)
    if stay.where(F.col(n) > 1).isEmpty():
        return kept.select(*docs.columns)
    once = kept.where(F.col(n) == 1).select(*docs.columns)
    whole = F.struct(*docs.columns)
    first = kept.where(F.col(n) > 1).groupBy(*keys).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(n)).select(f"{n}.*")
    return once.unionByName(first)
