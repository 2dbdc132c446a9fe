"""Substring look-ups against plain comparison, and the impact of all files against that of each."""

import random

from codestrata.operators import graph, impact, retrieval, substrings
from codestrata.plans import binding

DATA = "/root/testdata/sf0.001"


def like(pattern, text):
    """LIKE with the pattern between two ``%``, whatever the case."""
    p, t = f"%{pattern}%".lower(), text.lower()
    fits = [True] + [False] * len(t)
    for c in p:
        if c == "%":
            fits = [any(fits[: k + 1]) for k in range(len(fits))]
        else:
            fits = [False] + [fits[k] and c in ("_", t[k]) for k in range(len(t))]
    return fits[-1]


def random_text(r, n, alphabet="abAB_é. "):
    return "".join(r.choices(alphabet, k=r.randint(0, n)))


def test_substrings(spark):
    r = random.Random(7)
    texts = [(k, random_text(r, 12)) for k in range(60)] + [(100, None), (101, "")]
    patterns = [(k, random_text(r, 5, "abB_%é.")) for k in range(60)] + [(200, ""), (201, "__"), (202, "%"), (203, None)]
    given, wanted = spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(patterns, "p long, pattern string")
    found = substrings.matches(wanted, "pattern", given, "text")
    assert sorted((x["p"], x["t"]) for x in found.collect()) == sorted((p, t) for p, pattern in patterns for t, text in texts if pattern is not None and text is not None and like(pattern, text))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_like_search_by_its_index(spark):
    r = random.Random(8)
    nodes = spark.createDataFrame([(str(k), random_text(r, 6), random_text(r, 6), random_text(r, 6)) for k in range(80)], "id string, name string, signature string, docstring string")
    index = substrings.stored(lambda df: df, substrings.build(nodes, "id", retrieval.LIKE_COLUMNS))
    for query in ["a", "ab", "aba", "a_b", "_", "", "é.", "zzz", "AB_", "abab"]:
        assert retrieval.like_search(nodes, query, 1000, index).collect() == retrieval.like_search(nodes, query, 1000).collect()


def test_dependents_without_nested_loops(spark):
    nodes, edges = binding.nodes(spark, DATA), binding.edges(spark, DATA)
    found = graph.dependents_of_all(edges, nodes.select("file").distinct())
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and found.count()


def test_impact_of_all_files(spark):
    nodes = spark.createDataFrame(
        [("f1", "a", 1, False), ("f1", "b", 2, False), ("f1", "b", 3, False), ("f2", "c", 1, False), ("f2", "_p", 2, False), ("t", "test_c", 1, True), ("f3", "d", 1, False), ("only.py", "K", 1, False)], "file string, name string, line int, is_test boolean"
    ).selectExpr("concat(file, name, line) id", "name", "if(name = 'K', 'class', 'function') type", "file", "line", "concat('def ', name) signature", "is_test")
    edges = spark.createDataFrame(
        [(1, "b", "a", "calls", "f1"), (2, "c", "a", "calls", "f2"), (3, "c", "b", "calls", "f2"), (4, "d", "c", "calls", "f3"), (5, "a", "d", "calls", "f1"), (6, "test_c", "c", "calls", "t"), (7, "test_c", "c", "tests", "t"), (8, "", "a", "calls", "f9"), (9, "x", "m.f2", "imports", "f8"), (10, "e", "d", "calls", None)],
        "id long, from_name string, to_name string, type string, file string",
    ).selectExpr("*", "1 line", "'' from_id", "'' to_id")
    got = {r["changed_file"]: r.asDict() for r in impact.analyze_all_files(nodes, edges).collect()}
    assert set(got) == {"f1", "f2", "f3", "t", "only.py"}
    for file, row in got.items():
        assert impact.risk(impact.analyze_file(nodes, edges, file)).first().asDict() == row
    assert impact.analyze_all_files(nodes.limit(0), edges).count() == 0


def test_nearest_of_many(spark, monkeypatch):
    """Blocks of any size give each query's best by the rounded similarity, ties by id, with zero and repeated vectors."""
    r = random.Random(9)
    base = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(20)]
    rows = [(k, r.choice(base)) for k in range(150)] + [(150, [0.0] * 4), (151, None)]
    vectors = spark.createDataFrame(rows, "node_id long, vector array<float>").repartition(3)

    def similarity(a, b):
        p, q = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (p * q), 4) if p * q else 0.0

    want = set()
    for q, v in rows:
        if q % 10 == 0 and v is not None:
            best = sorted(((-similarity(v, w), k) for k, w in rows if w is not None))[:7]
            want |= {(q, k, -s + 0.0, place) for place, (s, k) in enumerate(best, 1)}
    for block in (3, 4096):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
        assert {tuple(x) for x in retrieval.nearest_many(vectors.where("node_id % 10 = 0"), vectors, 7).collect()} == want


def test_reranking_is_the_one_list_rule(spark):
    """Lists of many queries come out as each list does by itself: guards, the tests' penalty, ties by the list's order."""
    scores = lambda pairs: [((len(q) * 7 + len(d) * 13) % 17 - (9 if q.startswith("a") else 30)) / 4 for q, d in pairs]
    r = random.Random(10)
    rows = [(k, f"{'ab'[k % 2]} {['x', 'test'][k % 3 == 0]}", f"{k}-{n}", n, r.random() < 0.4, "d" * r.randint(0, 30)) for k in range(12) for n in range(1 if k == 5 else r.randint(2, 9))]
    got = {}
    for x in retrieval.rerank_many(spark.createDataFrame(rows, "query_id long, query string, id string, place int, is_test boolean, document string"), lambda: scores, 4).collect():
        got.setdefault(x["query_id"], {})[x["place"]] = (x["id"], x["rerank_score"])
    for k in range(12):
        mine = [{"id": x[2], "is_test": x[4], "name": x[5] or None} for x in rows if x[0] == k]
        want = retrieval.rerank(next(x[1] for x in rows if x[0] == k), mine, scores, 4)
        assert [got[k][p] for p in sorted(got[k])] == [(w["id"], w.get("rerank_score")) for w in want]
