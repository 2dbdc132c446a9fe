"""Look-ups on the code graph: callers, callees, tests, dependents, context, statistics.

Every look-up exists for one name (``name=...``: a filter that reaches the scan)
and for all names at once (``name=None``: the same plan keyed by the name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import substrings

CONTEXT_CALLERS, CONTEXT_CALLEES, CONTEXT_TESTS = 10, 5, 5


def _of(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


def nodes_in_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("file", "line")


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_file(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where(F.col("file") == file).orderBy("line")


def callers(nodes: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """(function, from_name, file, line, type, signature): who calls it, with the caller's node of the same file if there is one."""
    calls = _of(edges.where("type = 'calls'"), "to_name", name).select(F.col("to_name").alias("function"), "from_name", "file", "line").distinct()
    n = nodes.select(F.col("name").alias("from_name"), "file", "type", "signature").distinct()
    return calls.join(n, ["from_name", "file"], "left").select("function", "from_name", "file", "line", "type", "signature")


def callees(edges: DataFrame, name: str | None = None) -> DataFrame:
    """(function, to_name, file, line): what it calls."""
    return _of(edges.where("type = 'calls'"), "from_name", name).select(F.col("from_name").alias("function"), "to_name", "file", "line").distinct()


def tests_for(nodes: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """(function, test_name, test_file, line, signature): its tests, with every node of the test's name."""
    tests = _of(edges.where("type = 'tests'"), "to_name", name).select(F.col("to_name").alias("function"), F.col("from_name").alias("test_name"), F.col("file").alias("test_file"), "line").distinct()
    n = nodes.select(F.col("name").alias("test_name"), "signature").distinct()
    return tests.join(n, "test_name", "left").select("function", "test_name", "test_file", "line", "signature")


def dependents(edges: DataFrame, file: str) -> DataFrame:
    """(from_name, file): who imports something that holds the file's stem, whatever the case; ``_`` in it stands for any character."""
    pattern = X.stem(F.lit(file))
    return edges.where((F.col("type") == "imports") & F.ilike("to_name", F.concat(F.lit("%"), pattern, F.lit("%")))).select("from_name", "file").distinct()


def dependents_of_all(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(imported, from_name, file) for every file of ``files``: stems meet distinct targets by their rarest run of characters."""
    imports = edges.where("type = 'imports'")
    targets = imports.select("to_name").distinct()
    stems = files.select(F.col("file").alias("imported")).distinct().withColumn("stem", X.stem(F.col("imported")))
    hits = substrings.matches(stems, "stem", targets, "to_name").select("imported", "to_name")
    return imports.join(hits, "to_name").select("imported", "from_name", "file").distinct()


def _first_seen(edges: DataFrame, key: str, columns: list[str], limit: int) -> DataFrame:
    """The first ``limit`` distinct values of each key, in the order of their earliest edge."""
    distinct = edges.groupBy(F.col(key).alias("function"), *columns).agg(F.min("id").alias("first"))
    ranked = distinct.withColumn("place", F.row_number().over(W.partitionBy("function").orderBy("first", *columns)))
    return ranked.where(F.col("place") <= limit)


def context(nodes: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """(function, callers, callees, tests): the first few of each, callees only if they are nodes.

    Distinct pairs are pre-aggregated, and ranked with a limit per group that
    Spark applies before the shuffle, so a hub sends each task's first few.
    """
    calls, tests = edges.where("type = 'calls'"), edges.where("type = 'tests'")
    known = calls.join(nodes.select(F.col("name").alias("to_name")).distinct(), "to_name", "left_semi")
    listed = lambda df, value: df.groupBy("function").agg(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))).alias("l")).select("function", F.transform("l", lambda x: x["v"]).alias("l"))
    who = listed(_first_seen(_of(calls, "to_name", name), "to_name", ["from_name", "file"], CONTEXT_CALLERS), F.struct(F.col("from_name").alias("name"), "file")).withColumnRenamed("l", "callers")
    what = listed(_first_seen(_of(known, "from_name", name), "from_name", ["to_name"], CONTEXT_CALLEES), F.col("to_name")).withColumnRenamed("l", "callees")
    by = listed(_first_seen(_of(tests, "to_name", name), "to_name", ["from_name"], CONTEXT_TESTS), F.col("from_name")).withColumnRenamed("l", "tests")
    none = lambda kind: F.array().cast(kind)
    return who.join(what, "function", "full").join(by, "function", "full").select(
        "function", F.coalesce("callers", none("array<struct<name:string,file:string>>")).alias("callers"), F.coalesce("callees", none("array<string>")).alias("callees"), F.coalesce("tests", none("array<string>")).alias("tests")
    )


def stats_totals(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """One row: total_nodes, total_edges, total_files, total_embeddings."""
    n = nodes.agg(F.count("*").alias("total_nodes"), F.count_distinct("file").alias("total_files"))
    e = edges.agg(F.count("*").alias("total_edges"))
    v = embeddings.agg(F.count("*").alias("total_embeddings")) if embeddings is not None else None
    out = n.crossJoin(e)  # one row each
    return out.crossJoin(v) if v is not None else out.withColumn("total_embeddings", F.lit(0).cast("long"))


def stats_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, n): nodes by type and by language in one pass of grouping sets, edges by type."""
    counted = nodes.groupingSets([["type"], ["language"]], "type", "language").agg(F.grouping("type").alias("g"), F.count("*").alias("n"))
    n = counted.select(F.when(F.col("g") == 0, "node_type").otherwise("language").alias("kind"), F.when(F.col("g") == 0, F.col("type")).otherwise(F.col("language")).alias("value"), "n")
    e = edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge_type").alias("kind"), F.col("type").alias("value"), "n")
    return n.unionByName(e)


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """What a drawing needs of each node."""
    return nodes.select("id", "name", "type", "file", F.col("is_test").cast("int").alias("is_test"))


def graph_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, source, target, type): edges whose ends, by id or else by name, are nodes; of equal names the last by (file, line) counts."""
    by_name = nodes.groupBy("name").agg(F.max_by("id", F.struct("file", "line", "id")).alias("found"))
    end = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    source = by_name.select(F.col("name").alias("from_name"), F.col("found").alias("_source"))
    target = by_name.select(F.col("name").alias("to_name"), F.col("found").alias("_target"))
    linked = edges.join(source, "from_name", "left").join(target, "to_name", "left").select(F.col("id").alias("edge_id"), F.coalesce(end("from_id"), "_source").alias("source"), F.coalesce(end("to_id"), "_target").alias("target"), "type")
    ids = nodes.select("id")
    return linked.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("edge_id", "source", "target", "type")


def query_graph(nodes: DataFrame, edges: DataFrame, name: str, kind: str = "all") -> dict[str, DataFrame]:
    """The look-ups that ``kind`` names: callers, callees, tests or all."""
    out = {}
    if kind in ("callers", "all"):
        out["callers"] = callers(nodes, edges, name)
    if kind in ("callees", "all"):
        out["callees"] = callees(edges, name)
    if kind in ("tests", "all"):
        out["tests"] = tests_for(nodes, edges, name)
    return out


def files_touched(found: dict[str, DataFrame]) -> int:
    """One more than the distinct files of callers and callees."""
    parts = [found[k].select("file") for k in ("callers", "callees") if k in found]
    if not parts:
        return 1
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return 1 + both.where("file <> ''").agg(F.count_distinct("file")).first()[0]


def has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""
