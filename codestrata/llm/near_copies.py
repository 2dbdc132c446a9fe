"""Near copies by the Jaccard similarity of word shingles: prefix-filtered candidates, exact verification, components.

Two texts are near copies if their sets of ``WIDTH``-word shingles have a
Jaccard similarity of ``NUMERATOR / DENOMINATOR`` = 0.8 or more (in whole
numbers, no rounding). Words are those of ``words``; a shorter text is one
shingle, a text without words the empty set, equal only to itself.

Candidates. In any one order of all shingles, two sets of at least this
similarity share one of their first n - ceil(0.8 n) + 1 shingles. The order is
rare first: all texts are counted, in chunks of about ``CHUNK`` shingles, of which
those that stand twice in a chunk are added up and held in an array of ``BINS``.
The counts only shape the order, so they decide the work and never a result.
Shingles that two sets file are the keys.

Pruning. Sizes that cannot reach the similarity are left out. So are shared
shingles that stand too late: after the first that two sets share, no more can be
shared than either has left, so the smaller set has it in its first ninth. So are
pairs whose parities differ too often: a set's shingles flip the bits of a map, and
two maps differ in no more bits than the sets in shingles. Groups are compared by
maps of ``PARITIES`` bits, which say nothing of sets of some 2,300 shingles or more;
pairs then by maps with as many bits as the set has shingles.
None of it can lose a pair. The similarity of what is left is counted from both whole
sets, which are built for the classes in such pairs alone.

Fingerprints first. Texts whose SimHashes of the same shingles are within op10's
bound are found by its pigeonring (``simhash.hamming_links``) and are pairs to
verify, whatever keys they file. At a similarity of 0.8 some ten bits differ, so
most near copies are further apart; the keys above find those.

Keys of one group. A passage that several texts share gives a key for each of its
shingles, all with the same members. Of keys with the same members (their number,
least, greatest and two sums of hashes) the first in the order is kept: the others' pairs are its own.

Links. A key's group of at most ``SMALL`` members emits its pairs. A larger one is
compared inside a task, parity map by parity map, and emits no pairs but a
spanning forest of those that may be near; when these are verified, the group is
read once more and emits what may be near and still lies in different components.
So a group of copies, or of texts that share one passage, gives about as many rows
as it has members. Groups over ``GROUP`` members are dealt in blocks, and every
pair of blocks is one bounded sub-group, so no pair is lost and no task holds an
unbounded group.

Equal sets are one class from the start; a 64-bit hash names it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import simhash
from codestrata.llm.arrow import column, map_rows, utf8
from codestrata.llm.line_dedup import _bit_array, _hits, _slices
from codestrata.llm.scratch import Scratch
from codestrata.llm.simhash import components, keep_one
from codestrata.llm.words import Words, blocks, mix

WIDTH = 5
NUMERATOR, DENOMINATOR = 4, 5
#: Of the shingles' order: shingles that are counted at once (about), counts held.
CHUNK, BINS = 1 << 21, 1 << 20
SMALL = 8
GROUP = 4096
PARITIES, MOST_PARITIES = 1024, 1 << 24


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's shingles as sorted distinct 64-bit hashes."""
    text, h = Words(texts).shingle_hashes(width)
    order = np.argsort(h)
    # The stable sort of small numbers is a radix sort.
    order = order[np.argsort(text[order].astype(np.uint16 if len(texts) <= 1 << 16 else np.uint32), kind="stable")]
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    text, h = text[new], h[new]
    return np.split(h, np.searchsorted(text, np.arange(1, len(texts)))) if texts else []


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def prefix(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, of which a set as near as the bound shares one."""
    n = len(shingles)
    if not n:
        return shingles
    most = n + (-n * NUMERATOR // DENOMINATOR) + 1
    return shingles[np.lexsort((mix(shingles), counts[shingles & np.uint64(len(counts) - 1)]))[:most]]


def parities(shingles: np.ndarray, bits: int = PARITIES) -> bytes:
    """Which of ``bits`` bits the shingles flip an odd number of times."""
    return np.packbits(np.bincount((mix(shingles) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def own_parities(shingles: np.ndarray) -> bytes:
    """Parities with a bit for each shingle or more; empty where ``PARITIES`` are as many."""
    bits = min(1 << (len(shingles) - 1).bit_length(), MOST_PARITIES) if len(shingles) else 0
    return parities(shingles, bits) if bits > PARITIES else b""


def differing(s: bytes, other: bytes) -> int:
    """In how many bits parities differ; the longer (a power of two more) are folded to the shorter, as if made with as many bits."""
    x, y = sorted((np.frombuffer(s, np.uint64), np.frombuffer(other, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that two or more of the sets have, how many have them)."""
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    return found[n > 1], n[n > 1]


def _in_last(values: np.ndarray, rows: int) -> pa.Array:
    """``rows`` lists, all values in the last."""
    return pa.ListArray.from_arrays(pa.array([0] * rows + [len(values)], pa.int32()), pa.array(values), type=pa.list_(pa.field("element", pa.array(values).type)))


def _longs(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets))))).astype(np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)), type=pa.list_(pa.field("element", pa.int64())))


def _classes(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(i, row, fp: the class, sim: the SimHash) of every row; (s, n): with the last row of a chunk its shingles that stand twice, and how often."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: dict = {}
        held: list[np.ndarray] = []
        size = 0
        for batch in _slices(batches):
            at = 0
            for _, part in blocks(utf8(column(batch, "t"))):
                if out:
                    yield out
                sets = shingle_sets(part)
                fp = np.fromiter(map(class_of, sets), np.uint64, len(sets))
                out = {"i": column(batch, "i").slice(at, len(part)), "row": column(batch, "row").slice(at, len(part)), "fp": fp.view(np.int64), "sim": simhash.fingerprints(part, WIDTH).view(np.int64)}
                out |= {"s": _in_last(none, len(part)), "n": _in_last(none.astype(np.int32), len(part))}
                some = [sets[k] for k in np.unique(fp, return_index=True)[1]]  # a block's equal sets count once
                held += some
                size += sum(map(len, some))
                if size >= chunk:
                    out |= counted(held, len(part))
                    held, size = [], 0
                at += len(part)
        if out:
            yield out | counted(held, len(out["i"])) if held else out

    def counted(sets: list[np.ndarray], rows: int) -> dict:
        found, n = _often(sets)
        return {"s": _in_last(found.view(np.int64), rows), "n": _in_last(n.astype(np.int32), rows)}

    return map_rows(rows, f"i {rows.schema['i'].dataType.simpleString()}, row long, fp long, sim long, s array<long>, n array<int>", run)


def fingerprint_pairs(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of classes that span all links of their SimHashes; classes of one SimHash are linked to the least of them."""
    prints = scratch.table(classes.select("fp", "sim").distinct(), "prints")
    least = scratch.table(prints.groupBy("sim").agg(F.min("fp").alias("least")), "least")
    links = simhash.hamming_links(least.select(F.col("sim").alias("fp")), Scratch(classes.sparkSession, "pigeonring"))
    equal = prints.join(least, "sim").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    for end in ("a", "b"):
        links = links.join(least.select(F.col("sim").alias(end), F.col("least").alias(f"of_{end}")), end)
    near = links.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return equal.unionByName(near).where("a <> b").distinct()


def one_key_a_group(members: DataFrame) -> DataFrame:
    """(key, m: its members): of the keys with the same members the first, by its place ``p`` in the members' sets where that is given."""
    place = F.col("p") if "p" in members.columns else F.lit(0)
    groups = members.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("fp", place.alias("p"))).alias("low"), F.max("fp").alias("high"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"))
    # Where a key stands among one member's tells its place among them all.
    return groups.groupBy("m", "low.fp", "high", "x", "y").agg(F.min(F.struct("low.p", "key")).alias("first")).select("first.key", "m")


def _counts(classes: DataFrame) -> np.ndarray:
    """How many texts hold a bin's most frequent shingle, in the chunks where it stands twice; 0 where it is rare."""
    often = classes.where(F.size("s") > 0).select(F.explode(F.arrays_zip("s", "n")).alias("x")).groupBy(F.col("x.s").alias("h")).agg(F.sum("x.n").alias("n"))
    held = often.groupBy(F.col("h").bitwiseAND(F.lit(BINS - 1)).alias("at")).agg(F.least(F.max("n"), F.lit((1 << 31) - 1)).alias("n")).toArrow()
    out = np.zeros(BINS, np.int32)
    out[held.column("at").to_numpy()] = held.column("n").to_numpy()
    return out


def _keys(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(fp, n: the size of the set, s: its parities, own: those of its size, keys in their order): a block's equal sets file once."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches):
            for _, part in blocks(utf8(column(batch, "t"))):
                sets = shingle_sets(part)
                fp = np.fromiter(map(class_of, sets), np.uint64, len(sets))
                some = np.unique(fp, return_index=True)[1]
                yield {
                    "fp": fp[some].view(np.int64),
                    "n": [len(sets[k]) for k in some],
                    "s": [parities(sets[k]) for k in some],
                    "own": [own_parities(sets[k]) for k in some],
                    "keys": _longs([prefix(sets[k], shared.value) for k in some]),
                }

    return map_rows(rows.select("t"), "fp long, n int, s binary, own binary, keys array<long>", run)


def _members(keys: DataFrame, twice: DataFrame) -> DataFrame:
    """(key, fp, n, p: the key's place in the set's order) of the keys that two classes file."""
    shared = keys.sparkSession.sparkContext.broadcast(_bit_array(twice))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches, 4096):
            lists = column(batch, "keys")
            key = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = pc.list_parent_indices(lists).to_numpy()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            hit = _hits(key, shared.value)
            fp, n = (column(batch, x).to_numpy(zero_copy_only=False) for x in ("fp", "n"))
            yield {"key": key[hit].view(np.int64), "fp": fp[owner[hit]], "n": n[owner[hit]], "p": place[hit]}

    return map_rows(keys, "key long, fp long, n int, p int", run).join(twice, "key", "left_semi").distinct()


Group = dict[str, np.ndarray]
Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def _close(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the sizes alone allow the similarity."""
    return np.minimum(n, m) * DENOMINATOR >= np.maximum(n, m) * NUMERATOR


def _early(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can reach the similarity if the first that they share is at p and q in their orders."""
    return np.minimum(n - p, m - q) * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR


def _places(g: Group) -> np.ndarray:
    return g["p"] if "p" in g else np.zeros(len(g["fp"]), np.int64)


def _near_maps(s: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether parities differ in no more bits than sets of these sizes and the least similarity may in shingles."""
    return np.bitwise_count(s ^ other).sum(axis=-1, dtype=np.int64) * (NUMERATOR + DENOMINATOR) <= (n + m) * (DENOMINATOR - NUMERATOR)


def _maps(column_of: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column_of.to_pylist()), np.uint64).reshape(-1, PARITIES // 64)


def small_group(g: Group) -> Pairs:
    """All pairs whose sizes and places allow the similarity."""
    p = _places(g)
    for k in range(len(g["fp"]) - 1):
        n = g["n"][k + 1 :]
        there = np.flatnonzero(_close(n, g["n"][k]) & _early(n, p[k + 1 :], g["n"][k], p[k])) + k + 1
        yield np.full(len(there), g["fp"][k]), g["fp"][there]


def spanning(g: Group) -> Pairs:
    """A spanning forest of the members that may be near, breadth-first."""
    left, queue, p = np.arange(len(g["fp"])), [], _places(g)
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
            continue
        at = queue.pop()
        hit = _close(g["n"][left], g["n"][at]) & _early(g["n"][left], p[left], g["n"][at], p[at]) & _near_maps(g["s"][left], g["n"][left], g["s"][at], g["n"][at])
        found = left[hit]
        if len(found):
            yield np.full(len(found), g["fp"][at]), g["fp"][found]
            queue += found.tolist()
            left = left[~hit]


def between(g: Group) -> Pairs:
    """The pairs between components that may be near."""
    if (g["root"] == g["root"][0]).all():
        return
    p = _places(g)
    for k in range(len(g["fp"]) - 1):
        n, s, root = (g[x][k + 1 :] for x in ("n", "s", "root"))
        there = np.flatnonzero((root != g["root"][k]) & _close(n, g["n"][k]) & _early(n, p[k + 1 :], g["n"][k], p[k]))
        there = there[_near_maps(s[there], n[there], g["s"][k], g["n"][k])] + k + 1
        if len(there):
            yield np.full(len(there), g["fp"][k]), g["fp"][there]


def _pairs(members: DataFrame, by: list[str], group: Callable[[Group], Pairs]) -> DataFrame:
    """(a, b): what ``group`` gives for the rows of each key, which are sorted by the columns ``by``."""
    names = members.columns

    def made(found: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return {"a": pair[:, 0], "b": pair[:, 1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: Group | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in _whole(batches):
            now = None
            if batch is not None:
                now = {x: _maps(column(batch, x)) if x == "s" else column(batch, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names}
                if held is not None:
                    now = {x: np.concatenate((held[x], now[x])) for x in names}
            else:
                now = held
            if now is None:
                continue
            keys = np.stack([now[x] for x in by], axis=1)
            edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
            if batch is not None:  # the last group may go on
                held = {x: now[x][edge[-2] :] for x in names}
                edge = edge[:-1]
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                for pair in group({x: v[s:e] for x, v in now.items()}) if e - s > 1 else ():
                    found.append(pair)
                    rows += len(pair[0])
                    if rows >= 1 << 17:
                        yield made(found)
                        found, rows = [], 0
        if found:
            yield made(found)

    return map_rows(members, "a long, b long", run).where("a <> b").distinct()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then the end."""
    yield from (b for b in batches if b.num_rows)
    yield None


def _of_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with both classes' columns."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("fp").alias(end), *(F.col(c).alias(c + end) for c in sets.columns if c != "fp")), end)
    return pairs


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose parities allow the similarity, those of the sets' sizes where both have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches, 4096):
            n, m = (column(batch, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("na", "nb"))
            ok = _near_maps(_maps(column(batch, "sa")), n, _maps(column(batch, "sb")), m)
            own, other = column(batch, "owna"), column(batch, "ownb")
            for k in np.flatnonzero(ok & (pc.min_element_wise(pc.binary_length(own), pc.binary_length(other)).to_numpy(zero_copy_only=False) > 0)):
                ok[k] = differing(own[k].as_py(), other[k].as_py()) * (NUMERATOR + DENOMINATOR) <= (n[k] + m[k]) * (DENOMINATOR - NUMERATOR)
            yield {x: column(batch, x).filter(pa.array(ok)) for x in ("a", "b")}

    return map_rows(_of_both(pairs, sketches), "a long, b long", run)


def _sets(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, s: the shingles) of the classes in pairs, each from one of its texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    one = classes.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("key"))
    wanted = rows.sparkSession.sparkContext.broadcast(_bit_array(one.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in _slices(batches):
            hit = _hits(column(batch, "row").to_numpy(zero_copy_only=False).view(np.uint64), wanted.value)
            for _, part in blocks(utf8(column(batch, "t").filter(pa.array(hit)))):
                sets = shingle_sets(part)
                yield {"fp": np.fromiter(map(class_of, sets), np.uint64, len(sets)).view(np.int64), "s": _longs(sets)}

    # A bit array's mistakes go here.
    return map_rows(rows.select("t", "row"), "fp long, s array<long>", run).join(ends, "fp", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are as near as the bound, by both whole sets."""
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    enough = both * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.size("sa") + F.size("sb")).cast("long")
    return _of_both(pairs, sets).where(enough).select("a", "b").distinct()


def similar_links(rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, root): the components of classes over all pairs as near as the bound; ``rows``: (t, row).

    The texts are read for the classes, for the keys and, twice at most, for the
    whole sets of classes in pairs; all else works on written tables.
    """
    keys = scratch.table(_keys(rows, _counts(classes)), "keys")
    filed = keys.select("fp", "n", F.posexplode("keys").alias("p", "key"))
    # The smaller set of a pair has the first key that both have in its first ninth.
    first = (F.col("n") - F.col("p")) * (NUMERATOR + DENOMINATOR) >= F.col("n") * (2 * NUMERATOR)
    filed = filed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.max(first).alias("first"))
    twice = scratch.table(filed.where("low <> high and first").select("key"), "twice")
    members = scratch.table(_members(keys, twice), "members")
    sketches = scratch.table(keys.select("fp", "n", "s", "own").join(members.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "sketches")
    for done in ("keys", "twice"):
        scratch.drop(done)
    sized = scratch.table(one_key_a_group(members), "sized")
    large = sized.where(F.col("m") > SMALL).select("key", F.ceil(F.col("m") / (GROUP / 2)).cast("int").alias("parts"))
    small = members.join(sized.where(F.col("m") <= SMALL), "key", "left_semi").repartition("key").sortWithinPartitions("key", "fp")
    small = scratch.table(_pairs(small.select("key", "fp", "n", "p"), ["key"], small_group), "small")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    grouped = scratch.table(members.select("key", "fp", "p").join(large, "key").withColumn("block", own).join(sketches.drop("own"), "fp"), "grouped")
    for done in ("members", "sized"):
        scratch.drop(done)
    first = grouped.select("key", "block", "fp", "n", "p", "s").repartition("key", "block").sortWithinPartitions("key", "block", "fp")
    pairs = _alike(small.unionByName(_pairs(first, ["key", "block"], spanning)).distinct(), sketches).unionByName(fingerprint_pairs(classes, scratch)).distinct()
    links, rooted = None, None
    for k in range(2):
        pairs = scratch.table(pairs, f"pairs-{k}")
        for done in ("small",) if k == 0 else ("named-groups", "sketches"):
            scratch.drop(done)
        if not pairs.isEmpty():
            found = scratch.table(_similar(pairs, scratch.table(_sets(rows, classes, pairs), f"sets-{k}")), f"links-{k}")
            scratch.drop(f"sets-{k}")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                rooted = scratch.table(components(links, Scratch(rows.sparkSession, "components")), f"rooted-{k}")
        if k == 1:
            return rooted
        # Large groups that are not one component: every pair of blocks, without the pairs that were verified.
        named = grouped.withColumn("root", F.col("fp")) if rooted is None else grouped.join(rooted, grouped["fp"] == rooted["node"], "left").withColumn("root", F.coalesce("root", "fp"))
        named = scratch.table(named.select("key", "parts", "block", "fp", "n", "p", "s", "root"), "named-groups")
        scratch.drop("grouped")
        apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        ends = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, F.col("block")) * F.col("parts") + F.greatest(x, F.col("block")))
        dealt = named.join(apart, "key", "left_semi").select("key", F.explode(ends).alias("block"), "fp", "n", "p", "s", "root")
        dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "fp")
        pairs = _alike(_pairs(dealt, ["key", "block"], between).join(pairs, ["a", "b"], "left_anti"), sketches)
    return rooted


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay: of each component the one with the smallest id (null last; ties: by the text's hash)."""
    scratch = Scratch(docs.sparkSession, "copies")
    rows = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"), F.xxhash64(docs[id_column], docs[text_column]).alias("row"))
    classes = scratch.table(_classes(rows), "classes")
    prints = classes.select("i", "row", "fp")
    rooted = similar_links(rows, classes, scratch)
    named = prints.select("fp").distinct()
    if rooted is None:
        named = named.withColumn("root", F.col("fp"))
    else:
        named = named.join(rooted, named["fp"] == rooted["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return keep_one(docs, prints, scratch.table(named, "named"), scratch, id_column=id_column, text_column=text_column)
