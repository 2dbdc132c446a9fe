"""SQL table functions over a graph: ``select * from graph_callers('login')``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> None:
    """Views ``graph_nodes`` and ``graph_edges`` and functions on them. Bodies are SQL, so calls are inlined into the plan."""
    nodes.createOrReplaceTempView("graph_nodes")
    edges.createOrReplaceTempView("graph_edges")
    define = lambda name, given, columns, body: spark.sql(f"create or replace temporary function {name}({given} string) returns table({columns}) return {body}")
    define(
        "graph_callers", "wanted", "from_name string, file string, line int, type string, signature string",
        "select distinct e.from_name, e.file, e.line, n.type, n.signature from graph_edges e left join graph_nodes n on n.name = e.from_name and n.file = e.file where e.type = 'calls' and e.to_name = graph_callers.wanted",
    )
    define("graph_callees", "wanted", "to_name string, file string, line int", "select distinct to_name, file, line from graph_edges where type = 'calls' and from_name = graph_callees.wanted")
    define(
        "graph_tests", "wanted", "test_name string, test_file string, line int, signature string",
        "select distinct e.from_name, e.file, e.line, n.signature from graph_edges e left join graph_nodes n on n.name = e.from_name where e.type = 'tests' and e.to_name = graph_tests.wanted",
    )
    define("graph_dependents", "stem", "from_name string, file string", "select distinct from_name, file from graph_edges where type = 'imports' and to_name ilike concat('%', graph_dependents.stem, '%')")
