"""Substring look-ups by an index of short runs of characters, in place of comparing every pattern with every text.

A text is filed under each distinct run of one, two and three characters of its
lower-case form, and under the empty run. A pattern (``_`` any character, ``%`` any
run, as in LIKE) is looked up under runs of its longest literal piece: three
characters where it has them, else two, one or none. So short patterns and
patterns of wildcards alone have an exact way too; the latter meet every text,
as their result does. Of a pattern's runs the rarest one joins, and
``ilike`` verifies what it finds, so hits are exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import folds

LONGEST = 3
#: How many of a query's rarest runs are intersected before texts are read.
RAREST = 3
_WILD = r"[_%\\]"


def _runs_of(chars: Column, n: int) -> Column:
    """The runs of ``n`` characters of an array of characters."""
    some = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda k: F.array_join(F.slice(chars, k + 1, F.lit(n)), ""))
    return F.when(F.size(chars) >= n, some).otherwise(F.array().cast("array<string>"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), ""), lambda c: c != "")


def runs(text: Column) -> Column:
    """Under what a text is filed."""
    made = folds.bound(_chars(text), lambda c: F.concat(F.array(F.lit("")), *(_runs_of(c, n) for n in range(1, LONGEST + 1))))
    return F.when(text.isNotNull(), F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def needed(pattern: Column) -> Column:
    """Runs that each text with the pattern in it is filed under: those of its longest literal piece."""
    pieces = F.split(F.lower(pattern), _WILD, -1)
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]

    def of(chars: Column) -> Column:
        found = F.array(F.lit(""))
        for n in range(1, LONGEST + 1):
            found = F.when(F.size(chars) >= n, _runs_of(chars, n)).otherwise(found)
        return F.array_distinct(found)

    return folds.bound(_chars(longest), of)


def build(rows: DataFrame, key: str, columns: list[str], query: str | None = None) -> DataFrame:
    """(run, key): the index of several text columns; runs do not go over from one column to the next.

    An index is kept for many queries. For one ``query`` alone texts are filed only
    under its runs, of which they hold few or none: the rows are as good as hits.
    """
    if query is None:
        every = F.array_distinct(F.concat(*(runs(F.col(c)) for c in columns)))
    else:
        holds = lambda run: reduce(or_, (F.coalesce(F.contains(F.lower(c), F.lit(run)), F.lit(False)) for c in columns))
        every = F.array_compact(F.array(*(F.when(holds(run), F.lit(run)) for run in asked(query))))
    return rows.select(key, F.explode(every).alias("run")).select("run", key)


def counts(index: DataFrame) -> DataFrame:
    """(run, n): how many texts a run files."""
    return index.groupBy("run").agg(F.count("*").alias("n"))


def matches(patterns: DataFrame, pattern: str, texts: DataFrame, text: str) -> DataFrame:
    """Each row of ``patterns`` with each row of ``texts`` whose ``text`` holds it, whatever the case: an equi-join on the pattern's rarest run.

    Both sides are distinct before they meet, and meet with the other columns' rows last.
    """
    found = hits(patterns.select(F.col(pattern).alias("_pattern")), texts.select(F.col(text).alias("_text")))
    return patterns.join(found, patterns[pattern] == found["_pattern"]).join(texts.hint("merge"), F.col("_text") == texts[text]).drop("_pattern", "_text")


def hits(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(_pattern, _text): each distinct pattern with each distinct text that holds it.

    Texts are filed distinct, by the number of rows that say the same. The joins are
    by hints sorted ones: what a text is filed under is many times what the planner
    sees of its column, and broadcast by that estimate it would fill the driver.
    """
    distinct = texts.select("_text").distinct()
    filed = distinct.withColumn("_run", F.explode(runs(F.col("_text"))))
    often = filed.groupBy("_run").agg(F.count("*").alias("_n"))
    wanted = patterns.select("_pattern").distinct().select("_pattern", F.explode(needed(F.col("_pattern"))).alias("_run"))
    # A run that files nothing has the count 0: it is the rarest, and its pattern meets no text.
    rarest = wanted.join(often.hint("merge"), "_run", "left").groupBy("_pattern").agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), F.col("_run"))).alias("_run"))
    return rarest.join(filed.hint("merge"), "_run").where(F.ilike(F.col("_text"), F.concat(F.lit("%"), F.col("_pattern"), F.lit("%")))).select("_pattern", "_text")


def count_matches(patterns: DataFrame, pattern: str, texts: DataFrame, text: str) -> DataFrame:
    """(pattern, n): how many rows of ``texts`` hold each distinct pattern; rows that say the same are counted, not compared anew."""
    counted = texts.groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_n"))
    found = hits(patterns.select(F.col(pattern).alias("_pattern")), counted)
    return found.join(counted.hint("merge"), "_text").groupBy(F.col("_pattern").alias(pattern)).agg(F.sum("_n").alias("n"))


def asked(query: str) -> list[str]:
    """Runs that each text with the query in it is filed under, as ``needed``, of one literal."""
    longest = max(re.split(_WILD, query.lower()), key=len)
    n = min(LONGEST, len(longest))
    return sorted({longest[k : k + n] for k in range(len(longest) - n + 1)}) if n else [""]


def candidates(index: DataFrame, often: DataFrame, query: str, key: str) -> DataFrame:
    """The keys filed under the rarest runs of one query: a filter of literals on the index, which is clustered by run."""
    wanted = asked(query)
    known = {r["run"]: r["n"] for r in often.where(F.col("run").isin(wanted)).collect()}  # a row for each run of the query
    chosen = sorted(wanted, key=lambda run: (known.get(run, 0), run))[:RAREST]
    return index.where(F.col("run").isin(chosen)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(chosen)).select(key)


def stored(keep: Callable[[DataFrame], DataFrame], index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index and its counts, written by ``keep``, clustered by run."""
    by_run = lambda rows: rows.repartitionByRange("run").sortWithinPartitions("run")
    index = keep(by_run(index))
    return index, keep(by_run(counts(index)))
