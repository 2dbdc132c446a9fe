"""The graph that the star-schema tables hold, so that every graph operator has rows to work on.

Customers are functions, nations are files and classes, consecutive orders of a
week are calls. Ids come from the rows' own keys, never from a
global count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import text as X

TASKS_A_CORE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Few narrow columns from which much is made, dealt anew by a key.

    A scan's splits are the file's row groups, and one of those holds a million such
    rows: without this, all that is made of them is made by one task.
    """
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, by)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, dealt out anew only where its scan has fewer splits than there are cores."""
    found, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    functions = joined.select(
        F.col("c_name").alias("name"), F.lit("function").alias("type"), F.col("c_mktsegment").alias("language"), F.col("n_name").alias("file"), F.col("c_custkey").cast("int").alias("line"),
        F.concat(F.lit("def "), F.col("c_name"), F.lit("()")).alias("signature"), F.concat(F.lit("Handles "), F.lower("c_mktsegment")).alias("docstring"), (F.col("c_custkey") % 10 == 0).alias("is_test"),
    )
    classes = nation.select(
        F.col("n_name").alias("name"), F.lit("class").alias("type"), F.lit("nation").alias("language"), F.col("n_name").alias("file"), F.lit(0).alias("line"),
        F.concat(F.lit("class "), F.col("n_name")).alias("signature"), F.lit("").alias("docstring"), F.lit(False).alias("is_test"),
    )
    both = functions.unionByName(classes)
    empty = {"end_line": F.lit(0), "sha256": F.lit(""), "parent_class": F.lit(""), "body_preview": F.lit("")}
    return both.withColumn("id", X.node_id(F.col("file"), F.col("name"), F.col("line"))).withColumns(empty)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    who = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    w = W.partitionBy(F.date_trunc("week", "o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    steps = table(spark, sf_dir, "orders").withColumn("before", F.lag("o_custkey").over(w)).where(F.col("before").isNotNull())
    a, b = who.toDF("a_key", "a_name", "a_file"), who.select("c_custkey", "c_name").toDF("b_key", "b_name")
    calls = steps.join(a, F.col("before") == F.col("a_key")).join(b, F.col("o_custkey") == F.col("b_key"))
    edge = lambda df, number, key, source, target, kind, file, line: df.select((F.col(key).cast("long") * 8 + number).alias("id"), F.col(source).alias("from_name"), target.alias("to_name"), F.lit(kind).alias("type"), F.col(file).alias("file"), line.cast("int").alias("line"))
    line = F.col("a_key")
    parts = [
        edge(calls, 0, "o_orderkey", "a_name", F.col("b_name"), "calls", "a_file", line),
        edge(calls.where(F.col("a_key") % 10 == 0), 1, "o_orderkey", "a_name", F.col("b_name"), "tests", "a_file", line),
        edge(who, 2, "c_custkey", "c_name", F.col("n_name"), "member_of", "n_name", F.col("c_custkey")),
        edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), 3, "n_nationkey", "n_name", F.concat_ws(".", "r_name", "n_name"), "imports", "n_name", F.lit(1)),
        edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), 4, "n_nationkey", "n_name", F.col("r_name"), "inherits", "n_name", F.lit(0)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns({"from_id": F.lit(""), "to_id": F.lit("")})


#: The same graph as common table expressions.
GRAPH_SQL = """
nodes AS (
  SELECT substr(md5(file || '::' || name || '::' || line), 1, 12) AS id, * FROM (
    SELECT c_name AS name, 'function' AS type, c_mktsegment AS language, n_name AS file, CAST(c_custkey AS INT) AS line,
           'def ' || c_name || '()' AS signature, 'Handles ' || lower(c_mktsegment) AS docstring, c_custkey % 10 = 0 AS is_test
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT n_name, 'class', 'nation', n_name, 0, 'class ' || n_name, '', FALSE FROM nation)),
who AS (SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
steps AS (
  SELECT * FROM (
    SELECT *, lag(o_custkey) OVER (PARTITION BY date_trunc('week', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
  WHERE before IS NOT NULL),
calls_rows AS (
  SELECT s.o_orderkey, a.c_custkey AS a_key, a.c_name AS a_name, a.n_name AS a_file, b.c_name AS b_name
  FROM steps s JOIN who a ON s.before = a.c_custkey JOIN who b ON s.o_custkey = b.c_custkey),
edges AS (
  SELECT o_orderkey * 8 AS id, a_name AS from_name, b_name AS to_name, 'calls' AS type, a_file AS file, CAST(a_key AS INT) AS line FROM calls_rows
  UNION ALL SELECT o_orderkey * 8 + 1, a_name, b_name, 'tests', a_file, CAST(a_key AS INT) FROM calls_rows WHERE a_key % 10 = 0
  UNION ALL SELECT c_custkey * 8 + 2, c_name, n_name, 'member_of', n_name, CAST(c_custkey AS INT) FROM who
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 3, n_name, r_name || '.' || n_name, 'imports', n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 4, n_name, r_name, 'inherits', n_name, 0 FROM nation JOIN region ON n_regionkey = r_regionkey)
"""
