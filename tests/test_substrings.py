"""Substring matches of many equal texts."""

from codestrata.operators import substrings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matches_of_copies(spark):
    texts = spark.createDataFrame([("Blue ring",)] * 5 + [("red nut",), (None,), ("",)], "t string")
    patterns = spark.createDataFrame([("ring",), ("R",), ("__",), ("ring",), ("none",), ("%",)], "p string")
    counted = substrings.count_matches(patterns, "p", texts, "t")
    assert {r["p"]: r["n"] for r in counted.collect()} == {"ring": 5, "R": 6, "__": 6, "%": 7}
    assert "BroadcastHashJoin" not in plan(counted) and "BroadcastExchange" not in plan(counted)
    assert substrings.matches(patterns, "p", texts, "t").groupBy("p").count().where("p = 'ring'").first()["count"] == 10


def test_one_query_files_its_own_runs(spark):
    names = ["aBc", "abcd", "xabcz ABC", "", None, "ab", "ÄÖÜ", "bcd_x"]
    rows = spark.createDataFrame([(str(k), n, names[-k - 1]) for k, n in enumerate(names)], "id string, a string, b string")
    for query in ("abc", "a", "", "_", "ab%cd", "zzz", "äöü", "BCD_X"):
        wanted = substrings.asked(query)
        whole, own = substrings.build(rows, "id", ["a", "b"]), substrings.build(rows, "id", ["a", "b"], query)
        assert sorted(map(tuple, own.collect())) == sorted(tuple(r) for r in whole.collect() if r["run"] in wanted)
