"""What is made of a few narrow rows is made by all tasks; a line costs its length."""

import os

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import extract
from codestrata.plans import binding, fixtures

DATA = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@with_data
@pytest.mark.parametrize("name", sorted(fixtures.FIXTURES))
def test_sources_are_dealt_to_all_cores(spark, name):
    assert fixtures.sources(spark, DATA, fixtures.FIXTURES[name]).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@with_data
def test_nodes_are_dealt_to_all_cores(spark):
    functions = binding.nodes(spark, DATA).where("type = 'function'")
    assert functions.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_calls_begin_at_words(spark):
    lines = ["self.run(1)", "myself.go (cls.make(x))", "a.b.c(d)(e)", "x = " + "w" * 50_000, "no call", "ünï(ß_1  (", "(", "f\t(g(h)"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, t string")
    found = {r["k"]: r["c"] for r in rows.select("k", F.regexp_extract_all("t", F.lit(extract.PY_CALL), 1).alias("c")).collect()}
    assert found == {0: ["run"], 1: ["go", "make"], 2: ["c"], 3: [], 4: [], 5: ["ünï", "ß_1"], 6: [], 7: ["f", "g"]}


def test_strips_all_white_space(spark):
    blanks = [chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000 and chr(k).isspace()]
    rows = spark.createDataFrame([("".join(blanks) + "a \t b" + "".join(blanks),), ("",), (" ",), (None,)], "t string")
    found = [tuple(r) for r in rows.select(X.strip(F.col("t")), X.strip_left(F.col("t")), X.strip_right(F.col("t"))).collect()]
    every = "".join(blanks)
    assert found == [("a \t b", "a \t b" + every, every + "a \t b"), ("", "", ""), ("", "", ""), (None, None, None)]
