"""URL rules through a cascade of Bloom filters, in DataFrame functions alone.

Listed keys (host, path prefix) are encoded in a first Bloom filter. Over the
complete universe of keys that the corpus's URLs can ask for, its false
positives are encoded in a second filter, the listed keys that pass the second
one by mistake in a third, and so on until a level has no mistakes. A key is
listed exactly if the first level that rejects it is an even one. So membership
is exact for every key of the universe, and a URL is judged inside its row:
no join, no shuffle.

The filters are sized by the list, not by the corpus: level 1 lets a share of
about (listed / universe) pass, so later levels hold few keys. Keys of a long list
are dealt over several filters of at most ``MAX_BITS`` bits by their hash. The
filters of a level are one row that is written and broadcast: some ten bits a
listed key, whatever the corpus.

Defined cases: null URLs and those without ``://`` have an empty host and path
and fit no rule; rows are neither merged nor dropped; an empty rule list or an
empty table gives rows without rules or no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.arrow import fresh
from codestrata.llm.scratch import Scratch

HASHES = 4
#: The bits of one filter; longer lists have several.
MAX_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    # Cut first: a host pattern that may start at a later ``://`` would give an inner URL's path.
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def bit_positions(key: Column, bits: int, level: int) -> list[Column]:
    """The key's positions in a filter: double hashing of two seeded 64-bit hashes."""
    one, two = F.xxhash64(key, F.lit(2 * level)).bitwiseAND(F.lit(0x3FFFFFFFFFFFFFFF)), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1))
    return [F.pmod(one + k * two.bitwiseAND(F.lit(0x7FFFFFFFFF)) if k else one, F.lit(bits).cast("long")) for k in range(HASHES)]


def part_of(key: Column, parts: int) -> Column:
    """Which of a level's filters has the key."""
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts).cast("long"))


def bloom(keys: DataFrame, bits: int, parts: int, level: int) -> np.ndarray:
    """int64[parts, bits / 64]: the words of a level's filters. They are OR-ed map-side, so at most as many rows reach the driver, as one Arrow table."""
    start = part_of(F.col("key"), parts) * bits
    at = keys.select(F.explode(F.array(*(start + x for x in bit_positions(F.col("key"), bits, level)))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toArrow()
    out = np.zeros(parts * bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out.reshape(parts, -1)


def might_hold(key: Column, filters: Column, bits: int, parts: int, level: int) -> Column:
    """Whether the key's filter of a level (an array of arrays of words) accepts it."""
    words = F.get(filters, part_of(key, parts).cast("int"))
    tests = []
    for at in bit_positions(key, bits, level):
        word = F.get(words, F.floor(at / 64).cast("int"))
        tests.append(F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership of a list of keys among a universe of keys."""

    def __init__(self, scratch: Scratch, name: str, listed: DataFrame, universe: DataFrame, universe_size: int, max_levels: int = 24):
        """``listed`` and ``universe`` have one column ``key``; ``listed`` may hold keys outside the universe.

        Of the universe only level 1's false positives are written, about as many as listed keys.
        """
        self.name = name
        self.levels: list[tuple[int, int]] = []  # bits and filters of each
        self.tables: list[DataFrame] = []  # one row: the filters of each
        listed = scratch.table(listed.select("key").where(F.col("key").isNotNull()).distinct(), f"{name}-listed")
        # In each level: keys to hold, keys to keep out. The next level swaps what passed by mistake.
        held, out = listed, None
        for level in range(max_levels):
            n = held.count()
            if n == 0 and level:
                break
            share = math.sqrt(0.5) * max(n, 1) / max(universe_size, 2 * n, 2) if level == 0 else 0.5
            share = min(max(share, 1e-9), 0.5)
            per_key = HASHES / -math.log(1 - share ** (1 / HASHES))
            bits = max(64, 1 << math.ceil(math.log2(max(1, n) * per_key)))
            # A list beyond one filter's bound is dealt over several by the keys' hashes.
            parts = max(1, bits // MAX_BITS)
            bits //= parts
            words = bloom(held, bits, parts, level)
            each = pa.ListArray.from_arrays(np.arange(parts + 1, dtype=np.int32) * words.shape[1], words.ravel())
            rows = pa.table({self._column(level): pa.ListArray.from_arrays([0, parts], each)})
            self.tables.append(scratch.table(held.sparkSession.createDataFrame(rows), f"{name}-filter-{level}"))
            self.levels.append((bits, parts))
            seen = (out or universe).select("key").crossJoin(F.broadcast(self.tables[-1]))  # one row
            passed = seen.where(might_hold(F.col("key"), F.col(self._column(level)), bits, parts, level)).select("key").distinct()
            if level == 0:
                passed = passed.join(listed, "key", "left_anti")
            held, out = scratch.table(passed, f"{name}-{level}"), held
        else:
            raise ValueError("the cascade did not end; two keys share all their hashes")

    def _column(self, level: int) -> str:
        return f"__filter_{self.name}_{level}"

    def beside(self, rows: DataFrame) -> DataFrame:
        """The rows with the filters of all levels: a broadcast of one row a level, whose size is the list's."""
        for table in self.tables:
            rows = rows.crossJoin(F.broadcast(table))
        return rows

    def holds(self, key: Column) -> Column:
        """Listed exactly if the first level that rejects the key is an even one (counted from 1); for rows that have the filters ``beside``."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            bits, parts = self.levels[level]
            out = F.when(might_hold(key, F.col(self._column(level)), bits, parts, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def candidates(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """The rule keys that a URL can ask for, longest host first, longest path first: array<struct<host, path>>.

    ``lengths``: the lengths that listed paths have; ``labels``: the most labels of a listed host.
    """
    parts = F.split(host, "\\.")
    wanted = []
    for n in range(labels, 0, -1):
        suffix = F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "."))
        for length in sorted(lengths, reverse=True):
            wanted.append(F.when(suffix.isNotNull() & (suffix != "") & (F.length(path) >= length), F.struct(suffix.alias("host"), F.substring(path, 1, length).alias("path"))))
    return F.filter(F.array(*wanted), lambda x: x.isNotNull())


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, *, url_column: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to every row.

    ``rules``: (verdict, host + path prefix), like ``("block", "example.org/es/")``;
    the longest that fits wins. One cascade for each verdict holds its keys. A
    URL with no listed key gets ``default``: it is not on the list.
    """
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")
    rules = rules.select("verdict", "rule", F.expr("translate(substring_index(rule, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").alias("host"), F.expr("case when instr(rule, '/') > 0 then substr(rule, instr(rule, '/')) else '' end").alias("path"))
    rules = rules.withColumn("key", key_of(F.col("host"), F.col("path")))
    shape = rules.agg(F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set("verdict").alias("verdicts")).first()
    clash = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")]
    base = pages.drop(*clash).withColumn("host", host_of(pages[url_column])).withColumn("path", path_of(pages[url_column]))
    if not shape["verdicts"]:
        return base.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    asked = candidates(F.col("host"), F.col("path"), shape["lengths"], shape["labels"])
    universe = base.select(F.explode(F.transform(asked, lambda x: key_of(x["host"], x["path"]))).alias("key"))
    size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    scratch = Scratch(spark, "urls")
    cascades = {v: Cascade(scratch, f"v{k}", rules.where(F.col("verdict") == v), universe, size) for k, v in enumerate(sorted(shape["verdicts"]))}
    columns = base.columns
    for cascade in cascades.values():
        base = cascade.beside(base)
    hit = asked
    tagged = F.transform(hit, lambda x: F.struct(key_of(x["host"], x["path"]).alias("rule"), _verdict(cascades, key_of(x["host"], x["path"])).alias("verdict")))
    fits = F.filter(tagged, lambda x: x["verdict"].isNotNull())
    # The longest rule; candidates of one length are one key.
    best = F.aggregate(fits, F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")), lambda a, x: F.when(a["rule"].isNull() | (F.length(x["rule"]) > F.length(a["rule"])), x).otherwise(a))
    (found,) = fresh(base, "best")
    return base.select(*columns, best.alias(found)).withColumn("rule", F.col(found)["rule"]).withColumn("verdict", F.coalesce(F.col(found)["verdict"], F.lit(default))).drop(found)


def _verdict(cascades: dict[str, Cascade], key: Column) -> Column:
    """The verdict of the list that holds the key, or null; of several, the first by name."""
    out = F.lit(None).cast("string")
    for verdict in sorted(cascades, reverse=True):
        out = F.when(cascades[verdict].holds(key), F.lit(verdict)).otherwise(out)
    return out
