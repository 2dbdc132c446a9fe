"""Impact of a changed file: bounded reverse reachability, tests, risk and review order.

The search goes level by level, each level one join of the last level's names
with the call edges. The order in which names are found decides their reason, so
every name carries its path (the changed function's line, then the edges' ids);
paths compare as arrays, the least one wins. That needs neither a global sort nor
a global row number: the winners are pre-aggregated minima.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import graph

# Weights of the risk, its levels, the cap, the indirect files of a review.
DIRECT, INDIRECT, UNTESTED, CHANGED = 3, 1, 5, 2
LEVELS = [(50, "critical"), (30, "high"), (15, "medium")]
RISK_CAP = 100
REVIEW_INDIRECT = 5
TOKENS_PER_FILE = 800
#: Files that are numbered in one group.
BUCKET = 4096

#: Writes a table and reads it back, or leaves it lazy.
Keep = Callable[[DataFrame], DataFrame]


@dataclass
class Impact:
    """The parts of a file's impact as lazy tables."""

    file: str
    changed: DataFrame  # name, line
    affected: DataFrame  # depth, path, function, file, reason, risk
    covered: DataFrame  # test_name, test_file, covers
    missing: DataFrame  # function, line
    dependents: DataFrame  # from_name, file

    @property
    def direct(self) -> DataFrame:
        return self.affected.where("depth = 1")

    @property
    def indirect(self) -> DataFrame:
        return self.affected.where("depth > 1")

    def files(self) -> DataFrame:
        """Distinct files: the changed one, callers', tests' and dependents'."""
        spark = self.changed.sparkSession
        own = spark.createDataFrame([(self.file,)], "file string")
        parts = [self.affected.select("file"), self.covered.select(F.col("test_file").alias("file")), self.dependents.select("file")]
        out = own
        for part in parts:
            out = out.union(part.where(graph.has_text(F.col("file")) & (F.col("file") != "unknown")))
        return out.distinct()


def analyze_file(nodes: DataFrame, edges: DataFrame, file: str, max_depth: int = 3, keep: Keep = lambda level: level) -> Impact:
    """The impact of a change to ``file`` over at most ``max_depth`` levels of callers.

    Changed functions are not visited in advance: one that calls another counts
    as affected. Names are visited once, whatever their file. Each level is
    read by the next ones and by most answers; with ``keep`` the levels, which
    hold only the names that were reached, are persisted (``release`` frees
    them), so each level reads the edges once.
    """
    changed = nodes.where((F.col("file") == file) & (F.col("type") == "function")).select("name", "line", "id")
    calls = edges.where(F.col("type") == "calls").where(graph.has_text(F.col("from_name"))).select(F.col("to_name").alias("via"), F.col("from_name").alias("function"), F.coalesce("file", F.lit("unknown")).alias("file"), F.col("id").alias("edge"))
    frontier = changed.groupBy(F.col("name").alias("via")).agg(F.min(F.array(F.col("line").cast("long"))).alias("path"))
    levels, visited = [], None
    for depth in range(1, max_depth + 1):
        found = calls.join(frontier, "via").select("function", F.struct(F.concat("path", F.array("edge")).alias("path"), "via", "file").alias("how"))
        level = found.groupBy("function").agg(F.min("how").alias("how")).select("function", F.col("how.path").alias("path"), F.col("how.via").alias("via"), F.col("how.file").alias("file"))
        if visited is not None:
            level = level.join(visited, "function", "left_anti")
        level = keep(level)
        reason = F.concat(F.lit("directly calls ") if depth == 1 else F.lit(f"indirectly affected (depth {depth}) via "), F.col("via"))
        risk = "high" if depth == 1 else "medium" if depth == 2 else "low"
        levels.append(level.select(F.lit(depth).alias("depth"), "path", "function", F.when(F.col("file") != "", F.col("file")).otherwise("unknown").alias("file"), reason.alias("reason"), F.lit(risk).alias("risk")))
        seen = level.select("function")
        visited = seen if visited is None else visited.union(seen)
        frontier = level.select(F.col("function").alias("via"), "path")
    affected = levels[0]
    for level in levels[1:]:
        affected = affected.unionByName(level)
    tests = graph.tests_for(nodes, edges).select(F.col("function").alias("name"), "test_name", "test_file")
    covered = changed.join(tests, "name").select("test_name", F.when(graph.has_text(F.col("test_file")), F.col("test_file")).otherwise("unknown").alias("test_file"), F.col("name").alias("covers"))
    missing = changed.join(edges.where("type = 'tests'").select(F.col("to_name").alias("name")).distinct(), "name", "left_anti").where(~F.col("name").startswith("_")).select(F.col("name").alias("function"), "line")
    return Impact(file, changed.select("name", "line"), affected, covered, missing, graph.dependents(edges, file))


def risk(impact: Impact) -> DataFrame:
    """One row: changed_file, error, counts, risk_score (capped), risk_level (of the uncapped score), affected_file_count."""
    counts = (
        impact.changed.agg(F.count("*").alias("n_changed"))
        .crossJoin(impact.affected.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_direct"), F.count(F.when(F.col("depth") > 1, 1)).alias("n_indirect")))
        .crossJoin(impact.covered.agg(F.count("*").alias("n_covered")))
        .crossJoin(impact.missing.agg(F.count("*").alias("n_missing")))
        .crossJoin(impact.files().agg(F.count("*").alias("affected_file_count")))
    )
    error = F.when(F.col("n_changed") == 0, F.lit(f"No nodes found for {impact.file}"))
    return _scored(counts.withColumns({"changed_file": F.lit(impact.file), "error": error}))


def _scored(counts: DataFrame) -> DataFrame:
    score = F.col("n_direct") * DIRECT + F.col("n_indirect") * INDIRECT + F.col("n_missing") * UNTESTED + F.greatest(F.col("n_changed") - 1, F.lit(0)) * CHANGED
    level = F.lit("low")
    for over, name in reversed(LEVELS):
        level = F.when(F.col("_score") > over, name).otherwise(level)
    return counts.withColumn("_score", score).select("changed_file", "error", "n_changed", "n_direct", "n_indirect", "n_covered", "n_missing", F.least("_score", F.lit(RISK_CAP)).alias("risk_score"), level.alias("risk_level"), "affected_file_count")


def _numbered(files: DataFrame) -> DataFrame:
    """(changed_file, word, bit): files in words of up to 64, numbered within buckets of about ``BUCKET`` by hash, so that no task numbers all."""
    buckets = F.floor(F.col("n") / BUCKET) + 1
    dealt = files.crossJoin(F.broadcast(files.agg(F.count("*").alias("n")))).select("changed_file", F.pmod(F.xxhash64("changed_file"), buckets).alias("bucket"))  # one row
    place = F.row_number().over(W.partitionBy("bucket").orderBy("changed_file")) - 1
    return dealt.withColumn("place", place).select("changed_file", (F.col("bucket") * (1 << 32) + F.floor(F.col("place") / 64)).alias("word"), (F.col("place") % 64).alias("bit"))


def _listed(words: DataFrame, files: DataFrame, *by: str) -> DataFrame:
    """(changed_file, *by, n): how many rows have the file's bit. Bits are counted before the shuffle."""
    counted = words.select("word", *by, F.explode(F.expr("filter(sequence(0, 63), b -> getbit(bits, b) = 1)")).alias("bit")).groupBy("word", "bit", *by).agg(F.count("*").alias("n"))
    return counted.join(files, ["word", "bit"]).select("changed_file", *by, "n")


def _found_in(changed: DataFrame, calls: DataFrame, levels: list[DataFrame], reached: DataFrame, files: DataFrame, max_depth: int, keep: Keep) -> DataFrame:
    """(changed_file, file): the files in which the changed file's reached names are found, by the least path of each pair.

    A name that calls from one file is found in that one. To names that call from
    several, and to all that these call within the levels left, pairs of a file and
    a name are followed with their paths, level by level.
    """
    homes = keep(calls.select("function", "file").distinct())
    many = keep(homes.groupBy("function").agg(F.count("*").alias("n")).where("n > 1").select("function"))
    if many.isEmpty():
        one = reached.join(homes, "function")
        return _listed(one.groupBy("word", "file").agg(F.expr("bit_or(bits)").alias("bits")), files, "file").select("changed_file", "file")
    one = reached.join(homes.join(many, "function", "left_anti"), "function")
    single = _listed(one.groupBy("word", "file").agg(F.expr("bit_or(bits)").alias("bits")), files, "file").select("changed_file", "file")
    # By level from the last: the names whose paths are asked for.
    needed = [many]
    for _ in range(1, max_depth):
        callees = calls.join(needed[0], "function", "left_semi").select(F.col("via").alias("function"))
        needed.insert(0, keep(many.union(callees).distinct()))
    frontier = changed.groupBy("changed_file", F.col("name").alias("via")).agg(F.min(F.array(F.col("line").cast("long"))).alias("path"))
    followed: list[DataFrame] = []
    for names in needed:
        least = calls.join(names, "function", "left_semi").groupBy("via", "function", "file").agg(F.min("edge").alias("edge"))
        found = least.join(frontier, "via").select("changed_file", "function", F.struct(F.concat("path", F.array("edge")).alias("path"), "file").alias("how"))
        level = found.groupBy("changed_file", "function").agg(F.min("how").alias("how")).select("changed_file", "function", "how.path", "how.file")
        for earlier in followed:
            level = level.join(earlier.select("changed_file", "function"), ["changed_file", "function"], "left_anti")
        level = keep(level)
        followed.append(level)
        frontier = level.select("changed_file", F.col("function").alias("via"), "path")
    pairs = reduce(DataFrame.unionByName, followed)
    return single.union(pairs.join(many, "function", "left_semi").select("changed_file", "file").distinct())


def analyze_all_files(nodes: DataFrame, edges: DataFrame, max_depth: int = 3, keep: Keep = lambda level: level) -> DataFrame:
    """``risk`` for every file that has a node, by one search from all of them.

    A level holds each name with the files that newly reach it, as bits of words of
    64 files: a message along a call is one word however many of its files reach
    the callee, words meet in pre-aggregated unions, and the work does not grow with
    pairs of a file and a name but with the words that have one. Which pairs a level
    has does not depend on paths; only the file that a pair is found in does, and
    that only where a name calls from several files. Paths are followed to such
    names alone (``_found_in``).
    """
    files = keep(_numbered(nodes.select(F.col("file").alias("changed_file")).distinct()))
    changed = nodes.where("type = 'function'").select(F.col("file").alias("changed_file"), "name", "line")
    calls = edges.where(F.col("type") == "calls").where(graph.has_text(F.col("from_name"))).select(F.col("to_name").alias("via"), F.col("from_name").alias("function"), F.coalesce("file", F.lit("unknown")).alias("file"), F.col("id").alias("edge"))
    steps = keep(calls.select("via", "function").distinct())
    union = F.expr("bit_or(bits)").alias("bits")
    frontier = changed.join(files, changed["changed_file"].eqNullSafe(files["changed_file"])).groupBy(F.col("name").alias("via"), "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    levels: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        level = steps.join(frontier, "via").groupBy("function", "word").agg(union)
        if levels:
            seen = reduce(DataFrame.unionByName, levels).groupBy("function", "word").agg(F.expr("bit_or(bits)").alias("seen"))
            level = level.join(seen, ["function", "word"], "left").select("function", "word", F.expr("bits & ~coalesce(seen, 0L)").alias("bits")).where("bits <> 0")
        level = keep(level.withColumn("depth", F.lit(depth)))
        levels.append(level)
        frontier = level.select(F.col("function").alias("via"), "word", "bits")
    reached = reduce(DataFrame.unionByName, levels)
    affected = _listed(reached.select("word", "bits", "depth"), files, "depth")
    found_in = _found_in(changed, calls, levels, reached, files, max_depth, keep)
    tests = graph.tests_for(nodes, edges).select(F.col("function").alias("name"), "test_file")
    covered = changed.join(tests, "name").select("changed_file", F.col("test_file").alias("file"))
    missing = changed.join(edges.where("type = 'tests'").select(F.col("to_name").alias("name")).distinct(), "name", "left_anti").where(~F.col("name").startswith("_"))
    dependents = graph.dependents_of_all(edges, nodes.select("file")).select(F.col("imported").alias("changed_file"), "file")
    touched = found_in.union(covered).union(dependents).union(files.select("changed_file", F.col("changed_file").alias("file")))
    touched = touched.where(graph.has_text(F.col("file")) & (F.col("file") != "unknown")).distinct()
    number = lambda rows, **named: rows.groupBy("changed_file").agg(*(c.alias(n) for n, c in named.items()))
    every = F.count("*")
    counts = files
    for part in (
        number(changed, n_changed=every),
        number(affected, n_direct=F.sum(F.when(F.col("depth") == 1, F.col("n"))), n_indirect=F.sum(F.when(F.col("depth") > 1, F.col("n")))),
        number(covered, n_covered=every),
        number(missing, n_missing=every),
        number(touched, affected_file_count=every),
    ):
        counts = counts.join(part, "changed_file", "left")
    counts = counts.na.fill(0, [c for c in counts.columns if c != "changed_file"])
    return _scored(counts.withColumn("error", F.when(F.col("n_changed") == 0, F.concat(F.lit("No nodes found for "), F.col("changed_file")))))


def review_order(impact: Impact) -> DataFrame:
    """(step, file, entry): the change, unseen files of direct callers, test files by name, unseen files of the first indirect callers.

    Test files do not count as seen, so one may stand twice. A review list is
    read by a person: its few files are numbered in one task.
    """
    spark: SparkSession = impact.changed.sparkSession
    first = F.array(F.lit(0).cast("long"))
    start = spark.range(1).select(F.lit(0).alias("group"), first.alias("path"), F.lit("").alias("name"), F.lit(impact.file).alias("file"), F.lit("the change").alias("why"))
    direct = impact.direct.where(F.col("file") != impact.file).groupBy("file").agg(F.min(F.struct("path", "reason")).alias("m")).select(F.lit(1).alias("group"), F.col("m.path").alias("path"), F.lit("").alias("name"), "file", F.concat(F.lit("direct dependent — "), F.col("m.reason")).alias("why"))
    seen = direct.select("file")
    tests = impact.covered.select(F.col("test_file").alias("file")).where(F.col("file") != impact.file).distinct().join(seen, "file", "left_anti").select(F.lit(2).alias("group"), first.alias("path"), F.col("file").alias("name"), "file", F.lit("test file").alias("why"))
    near = impact.indirect.orderBy("depth", "path").limit(REVIEW_INDIRECT)
    indirect = near.where(F.col("file") != impact.file).groupBy("file").agg(F.min(F.struct("depth", "path", "reason")).alias("m")).join(seen, "file", "left_anti").select((F.lit(2) + F.col("m.depth")).alias("group"), F.col("m.path").alias("path"), F.lit("").alias("name"), "file", F.concat(F.lit("indirect — "), F.col("m.reason")).alias("why"))
    every = start.unionByName(direct).unionByName(tests).unionByName(indirect)
    step = F.row_number().over(W.orderBy("group", "path", "name", "file"))
    return every.withColumn("step", step).select("step", "file", F.concat(F.col("step").cast("string"), F.lit(". "), F.col("file"), F.lit(" ("), F.col("why"), F.lit(")")).alias("entry"))


def analyze_function(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row: function, caller_count, callee_count, test_count, has_tests."""
    n = lambda df, label: df.agg(F.count("*").alias(label))
    out = n(graph.callers(nodes, edges, name), "caller_count").crossJoin(n(graph.callees(edges, name), "callee_count")).crossJoin(n(graph.tests_for(nodes, edges, name), "test_count"))
    return out.select(F.lit(name).alias("function"), "*", (F.col("test_count") > 0).alias("has_tests"))


def analyze_all_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``analyze_function`` for every function that is a node: (function, caller_count, callee_count, test_count, has_tests)."""
    names = nodes.where("type = 'function'").select(F.col("name").alias("function")).distinct()
    n = lambda df, label: df.groupBy("function").agg(F.count("*").alias(label))
    out = names.join(n(graph.callers(nodes, edges), "caller_count"), "function", "left").join(n(graph.callees(edges), "callee_count"), "function", "left").join(n(graph.tests_for(nodes, edges), "test_count"), "function", "left")
    return out.select("function", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("caller_count", "callee_count", "test_count")), (F.coalesce("test_count", F.lit(0)) > 0).alias("has_tests"))


def compare(risk_row: DataFrame, total_files: DataFrame) -> DataFrame:
    """One row: files and tokens with and without the graph. ``total_files``: one row, one column of that name."""
    affected = F.least("affected_file_count", "total_files")
    out = risk_row.select("changed_file", "affected_file_count").crossJoin(total_files.select("total_files"))
    out = out.withColumns({"files_with": affected, "tokens_without": F.col("total_files") * TOKENS_PER_FILE, "tokens_with": affected * TOKENS_PER_FILE})
    reduction = F.greatest(F.lit(1.0), F.col("tokens_without") / F.greatest("tokens_with", F.lit(1)))
    return out.select("changed_file", F.col("total_files").alias("files_without"), "files_with", "tokens_without", "tokens_with", F.format_string("%.1fx", reduction).alias("token_reduction"), (F.col("total_files") - F.col("files_with")).alias("files_saved"), (F.col("files_with") >= F.col("total_files")).alias("full_codebase_impact"))


def review_context(impact: Impact, risk_row: DataFrame, order: DataFrame, total_files: DataFrame) -> DataFrame:
    """One compact row for a reviewer; savings count the files of the review order."""
    entries = order.agg(F.array_sort(F.collect_list(F.struct("step", "entry"))).alias("e")).select(F.transform("e", lambda x: x["entry"]).alias("files_to_review"))
    direct = impact.direct.agg(F.array_sort(F.collect_list(F.struct("path", "function", "file", "risk", "reason"))).alias("d")).select(F.transform("d", lambda x: F.struct(x["function"].alias("function"), x["file"].alias("file"), x["risk"].alias("risk"), x["reason"].alias("reason"))).alias("affected_functions"))
    tests = impact.covered.agg(F.array_sort(F.collect_list("covers")).alias("covered")).crossJoin(impact.missing.agg(F.array_sort(F.collect_list("function")).alias("missing")))
    n = F.greatest(F.size("files_to_review"), F.lit(1))
    saving = F.round(F.col("total_files") / n, 1)
    return risk_row.crossJoin(entries).crossJoin(direct).crossJoin(tests).crossJoin(total_files.select("total_files")).select(
        "changed_file", "risk_level", "risk_score", F.format_string("%.1fx", saving).alias("token_savings"), n.alias("files_reviewed_with_kit"), F.col("total_files").alias("total_project_files"), "files_to_review", "affected_functions", "covered", "missing",
        F.when(F.size("missing") > 0, F.concat(F.size("missing").cast("string"), F.lit(" functions have NO tests"))).alias("warning"), F.col("n_indirect").alias("indirect_impact_count"),
    )
