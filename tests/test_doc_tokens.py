"""Tokens are counted in their row: no row a token is shuffled."""

import __spark_entry__ as entry


def test_rows_of_one_id_and_no_exploded_tokens(spark, tmp_path):
    rows = [(1, "Alpha beta alpha"), (1, "beta gamma x"), (2, ""), (3, None), (4, "a b c"), (5, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = entry.queries()["doc_tokens"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 5, 3), (5, 1, 1)]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
