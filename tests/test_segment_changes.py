"""A change of the index: documents are counted in their rows, and look-ups shuffle neither texts nor documents that stay."""

from collections import Counter

from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import segments


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_in_the_row(spark):
    texts = ["b a b c_c b", "", None, "ä a Ä z", "one", "x " * 400 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokens = docs.select("id", F.coalesce(X.index_tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    for row in tokens.select("tokens", X.counted(F.col("tokens")).alias("terms")).collect():
        assert [tuple(t) for t in row["terms"]] == sorted(Counter(row["tokens"]).items())


def test_a_change_shuffles_no_texts(spark, tmp_path):
    index = segments.TermIndex(spark, f"file://{tmp_path}/index")
    keep = lambda df: df.localCheckpoint()
    docs = spark.createDataFrame([(k, f"w{k} w") for k in range(20)], "id long, text string")
    forward = plan(index._forward(docs, keep))
    assert "Aggregate" not in forward and "Join" not in forward
    again = docs.unionByName(spark.createDataFrame([(3, "a"), (3, "zz zz"), (None, "p"), (None, "q")], "id long, text string"))
    got = {r["id"]: [tuple(t) for t in r["terms"]] for r in index._forward(again, keep).collect()}
    assert len(got) == 21 and got["3"] == [("zz", 2)] and got[None] == [("q", 1)] and got["4"] == [("w", 1), ("w4", 1)]
    assert index._forward(again, keep).count() == 21


def test_weights_take_one_shuffle(spark):
    counts = spark.createDataFrame([("1", "a", 2), ("1", "b", 1), ("2", "a", 1)], "id string, term string, tf long").localCheckpoint()
    vocab = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "term string, df long, idf double")
    found = segments.weighted(counts, vocab)
    assert plan(found).count("Join") == 1
    assert sorted((r["id"], r["term"], round(r["w"], 6)) for r in found.collect()) == [("1", "a", 0.707107), ("1", "b", 0.707107), ("2", "a", 1.0)]
