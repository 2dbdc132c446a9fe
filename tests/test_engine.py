"""Graph, impact, retrieval, incremental upkeep and the interfaces on small fixtures."""

import io
import json
import random
import threading
import urllib.request
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codestrata import rpc, server
from codestrata.functions import text as X
from codestrata.operators import cost, graph, impact, incremental, retrieval
from codestrata.project import Project

NODE = "id string, name string, type string, file string, line int, is_test boolean, signature string, language string"
EDGE = "id bigint, from_id string, to_id string, from_name string, to_name string, type string, file string, line int"


def make(spark, functions, edges):
    """functions: (name, file, line); edges: (from, to, type, file)."""
    nodes = spark.createDataFrame([(f"{n}@{f}", n, "function", f, k, n.startswith("test"), f"def {n}()", "python") for n, f, k in functions], NODE)
    rows = [(k, "", "", a, b, t, f, k) for k, (a, b, t, f) in enumerate(edges)]
    return nodes, spark.createDataFrame(rows, EDGE)


def reference(functions, edges, file, depth=3):
    """The same search over lists."""
    changed = [n for n, f, _ in sorted((x for x in functions if x[1] == file), key=lambda x: x[2])]
    callers = lambda name: [(a, f) for a, b, t, f in edges if t == "calls" and b == name]
    seen, direct, indirect = set(), [], []
    for name in changed:
        for a, f in callers(name):
            if a and a not in seen:
                seen.add(a)
                direct.append((a, f, f"directly calls {name}"))
    frontier = [d[0] for d in direct]
    for k in range(2, depth + 1):
        following = []
        for name in frontier:
            for a, f in callers(name):
                if a and a not in seen:
                    seen.add(a)
                    indirect.append((a, f, f"indirectly affected (depth {k}) via {name}"))
                    following.append(a)
        frontier = following
    return direct, indirect


@pytest.mark.parametrize("seed", range(4))
def test_impact_like_lists(spark, seed):
    r = random.Random(seed)
    names = [f"f{k}" for k in range(14)]
    functions = [(n, f"m{k % 4}.py", k) for k, n in enumerate(names)]
    where = {n: f for n, f, _ in functions}
    pairs = {(r.choice(names), r.choice(names)) for _ in range(24)}
    edges = [(a, b, "calls", where[a]) for a, b in sorted(pairs, key=lambda p: r.random())] + [("", "f0", "calls", "m1.py")]
    found = impact.analyze_file(*make(spark, functions, edges), "m0.py")
    direct, indirect = reference(functions, edges, "m0.py")
    get = lambda df: [(x["function"], x["file"], x["reason"]) for x in df.orderBy("depth", "path").collect()]
    assert get(found.direct) == direct and get(found.indirect) == indirect


@pytest.mark.parametrize(("n", "score", "level"), [(0, 5, "low"), (4, 17, "medium"), (9, 32, "high"), (16, 53, "critical"), (40, 100, "critical")])
def test_risk(spark, n, score, level):
    functions = [("a", "x.py", 1), *((f"c{k}", "y.py", k) for k in range(n))]
    nodes, edges = make(spark, functions, [(f"c{k}", "a", "calls", "y.py") for k in range(n)])
    row = impact.risk(impact.analyze_file(nodes, edges, "x.py")).first()
    assert (row["risk_score"], row["risk_level"]) == (score, level)


def test_unknown_file_and_review(spark):
    nodes, edges = make(spark, [("a", "x.py", 1), ("b", "y.py", 1), ("test_a", "t.py", 1), ("c", "z.py", 1)], [("b", "a", "calls", "y.py"), ("test_a", "a", "tests", "t.py"), ("c", "b", "calls", "z.py")])
    none = impact.risk(impact.analyze_file(nodes, edges, "nope.py")).first()
    assert none["error"] and none["risk_score"] == 0 and none["risk_level"] == "low" and none["affected_file_count"] == 1
    entries = [r["entry"] for r in impact.review_order(impact.analyze_file(nodes, edges, "x.py")).orderBy("step").collect()]
    assert entries == ["1. x.py (the change)", "2. y.py (direct dependent — directly calls a)", "3. t.py (test file)", "4. z.py (indirect — indirectly affected (depth 2) via b)"]
    row = impact.analyze_function(nodes, edges, "a").first()
    assert (row["caller_count"], row["callee_count"], row["test_count"], row["has_tests"]) == (1, 0, 1, True)


def test_dependents_wildcard(spark):
    _, edges = make(spark, [], [("m", "pkg.time_utils.x", "imports", "m.py"), ("n", "pkg.TIMExUTILS", "imports", "n.py"), ("o", "pkg.timeutils", "imports", "o.py")])
    assert {r["from_name"] for r in graph.dependents(edges, "lib/time_utils.py").collect()} == {"m", "n"}


def test_context_limits_and_links(spark):
    nodes, edges = make(spark, [("a", "x.py", 1), ("b", "x.py", 2), ("b", "y.py", 1)], [(f"c{k:02}", "a", "calls", "z.py") for k in range(12)] + [("a", "b", "calls", "x.py"), ("a", "gone", "calls", "x.py")])
    row = graph.context(nodes, edges, "a").where("function = 'a'").first()
    assert [c["name"] for c in row["callers"]] == [f"c{k:02}" for k in range(10)] and row["callees"] == ["b"] and row["tests"] == []
    assert [tuple(r)[1:] for r in graph.graph_links(nodes, edges).collect()] == [("a@x.py", "b@y.py", "calls")]


def test_query_shapes(spark):
    asked = {"login_user": "keyword", "AuthService": "keyword", "getUser": "keyword", "login": "hybrid", "auth logic": "hybrid", " login_user ": "keyword", "Auth": "hybrid", "": "hybrid"}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r["q"]: r["m"] for r in df.select("q", X.query_mode(F.col("q")).alias("m")).collect()} == asked
    X.register(spark)
    assert spark.sql("select query_mode('login_user') a, node_id('f', 'n', 3) b, tfidf_tokens('Ab c_de') c").first()["c"] == ["ab", "de"]


def test_search(spark):
    rows = [("1", "verify_token", "function", "auth.py", 1, False, "def verify_token(t)", "python"), ("2", "test_verify_token", "function", "t.py", 1, True, "def test_verify_token()", "python"), ("3", "save_order", "function", "o.py", 1, False, "def save_order(o)", "python"), ("4", "Cache", "class", "c.py", 1, False, "class Cache", "python")]
    nodes = spark.createDataFrame(rows, NODE).withColumns({"docstring": F.lit("x" * 130 + " "), "body_preview": F.lit(""), "parent_class": F.lit("")})
    vectors, vocab = retrieval.embed_nodes(nodes, size=32)
    found = retrieval.keyword_search(nodes, "verifyToken").orderBy("place").collect()
    assert {r["id"] for r in found} == {"1", "2"} and [r["place"] for r in found] == [0, 1]
    near = retrieval.semantic_search(nodes, vectors, retrieval.query_vector(spark, "save order", vocab, 32), 2).orderBy(F.col("similarity").desc()).collect()
    assert near[0]["id"] == "3" and len(vectors.first()["vector"]) == 32
    vectors384, vocab384 = retrieval.embed_nodes(nodes)
    best = retrieval.hybrid_search(nodes, vectors384, vocab384, "verify token").collect()
    assert best[0]["name"] == "verify_token" and best[0]["docstring"].endswith("x…")
    assert retrieval.like_search(nodes, 'token"').count() == 0 and retrieval.like_search(nodes, "TOKEN").count() == 2


def test_fusion_edges(spark):
    said = spark.createDataFrame([("a", 0), ("b", 1)], "id string, place int")
    near = spark.createDataFrame([("b", 0.5), ("c", 0.5)], "id string, similarity double")
    tests = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "id string, is_test boolean")
    get = lambda wants: {r["id"]: r["score"] for r in retrieval.fuse(said, near, tests, 5, wants).collect()}
    assert get(False) == {"a": 0.26, "b": 0.2} and get(True) == {"a": 0.4, "b": 0.2}


def test_rerank_guards():
    rows = [{"name": "a", "is_test": True}, {"name": "b"}, {"name": "c"}]
    assert retrieval.rerank("q", rows, None, 2) == rows[:2]
    assert retrieval.rerank("q", rows, lambda p: [-1, -2, -3], 2) == rows[:2]
    assert [r["name"] for r in retrieval.rerank("q", rows, lambda p: [0.8, 0.5, 0.1])] == ["b", "a", "c"]
    assert [r["name"] for r in retrieval.rerank("a test", rows, lambda p: [0.8, 0.5, 0.1])] == ["a", "b", "c"]


def test_renames_and_debounce(spark):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    events = [("delete", "old", "h", at(0)), ("create", "new", "h", at(4)), ("delete", "p", "g", at(0)), ("create", "q", "g", at(9)), ("delete", "r", "k", at(0)), ("delete", "s", "k", at(1)), ("create", "u", "k", at(2)), ("create", "v", "k", at(3))]
    found = incremental.rename_match(spark.createDataFrame(events, "kind string, file string, hash string, ts timestamp"))
    assert {(r["old_file"], r["new_file"]) for r in found.collect()} == {("old", "new"), ("s", "u")}
    times = [("a", at(s)) for s in (0, 0.9, 1.0, 1.5, 1.9, 2.0, 9)] + [("b", at(0.5))]
    kept = incremental.debounce(spark.createDataFrame(times, "file string, ts timestamp"))
    assert sorted((r["file"], (r["ts"] - t).total_seconds()) for r in kept.collect()) == [("a", 0), ("a", 1.0), ("a", 2.0), ("a", 9), ("b", 0.5)]


def test_debounce_like_a_loop(spark):
    """Many keys, one hot, over several batches, against a plain loop."""
    r = random.Random(4)
    t = datetime(2024, 1, 1)
    rows = [(r.choice(["hot"] * 5 + [f"f{k}" for k in range(20)]), t + timedelta(milliseconds=r.randint(0, 400_000))) for _ in range(30_000)] + [(None, t), (None, t), ("f0", None)]
    want = []
    for key in {k for k, _ in rows}:
        last = None
        for ts in sorted(x for k, x in rows if k == key and x):
            if last is None or ts >= last + timedelta(seconds=1):
                want.append((str(key), ts))
                last = ts
    got = [(str(x["file"]), x["ts"]) for x in incremental.debounce(spark.createDataFrame(rows, "file string, ts timestamp").repartition(7)).collect()]
    assert sorted(got) == sorted(want)


def test_round_like_python(spark):
    r = random.Random(3)
    values = [0.12345, 0.03125, 0.09375, -0.03125, -0.12345, 1.00005, 0.5, 0.0, -0.0, 2.675, 1e15, 123456.78905, 0.00005, 0.00015, 1.0, float("1e300")]
    values += [r.random() for _ in range(2000)] + [r.randint(0, 10**6) / 10**5 for _ in range(2000)] + [-r.randint(0, 10**6) / 10**5 for _ in range(500)] + [r.randint(0, 2**20) / 2**16 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.round_even(F.col("v"), 4).alias("r"))
    assert all(row["r"] == round(row["v"], 4) for row in df.collect())


def test_folding_of_all_characters(spark):
    """Full-text tokens of Vietnamese, Greek, combining marks and every assigned character, as DuckDB folds them."""
    import unicodedata

    import duckdb

    texts = ["Tiếng Việt đã được", "Ελληνικά ΐ Ά ώρα", "e\u0301cole n\u0303o \u0301x", "Ǆungla ḟ ẛ̣ ﬁ", "İstanbul ığdır", "हिन्दी ไทย", "가나다 \U0001d160"]
    letters = [chr(k) for k in range(0x80, 0x20000) if unicodedata.category(chr(k))[0] in "LNM" and chr(k).lower() == chr(k)]
    texts += ["a" + c + "b" for c in letters]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r["k"]: r["x"] for r in df.select("k", X.index_tokens(F.col("t")).alias("x")).collect()}
    db = duckdb.connect()
    want = db.execute(r"SELECT k, list_filter(regexp_split_to_array(strip_accents(lower(t)), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM (SELECT unnest(?) AS t, unnest(?) AS k)", [texts, list(range(len(texts)))]).fetchall()
    wrong = [(texts[k], got[k], w) for k, w in want if got[k] != w]
    assert len(want) == len(texts) and all(unicodedata.category(t[1]) in ("Lo", "No", "Nd", "Nl", "Ll", "Lm") for t, *_ in wrong) and len(wrong) < 0.02 * len(texts) and not [w for w in wrong if w[0] in texts[:7]], wrong[:20]


def test_node_ids_are_unique(spark):
    """One name on one line is one node, as the last of its rules has it; of repeated ids in a batch the last stays."""
    from codestrata.operators import extract, store

    sources = spark.createDataFrame([("a.kt", "kotlin", "data class Foo(val x: Int)\nfun bar(x: Int) {}\n", "h"), ("a.js", "javascript", "class Foo(x) {\n", "h"), ("A.java", "java", "public class Foo(int x) {\n", "h")], "file string, language string, source string, sha256 string")
    nodes = extract.parse(sources)[0]
    assert sorted((r["file"], r["name"], r["type"]) for r in nodes.collect()) == [("A.java", "Foo", "function"), ("a.js", "Foo", "class"), ("a.kt", "Foo", "class"), ("a.kt", "bar", "function")]
    old = spark.createDataFrame([("1", "a", "f", 1), ("2", "b", "f", 2)], "id string, name string, file string, line int")
    new = spark.createDataFrame([("2", "x", "f", 2), ("2", "y", "f", 3), ("3", "c", "g", 1), ("3", "c", "g", 1)], old.schema)
    assert sorted(map(tuple, store.upsert_nodes(old, new).collect())) == [("1", "a", "f", 1), ("2", "y", "f", 3), ("3", "c", "g", 1)]


def test_store_moments(spark, tmp_path):
    """Readers of a snapshot keep the tables of one moment; a change that lost its number is refused; old folders go."""
    from codestrata.operators.store import KEPT, Store

    store = Store(spark, str(tmp_path / "s"))
    frame = lambda n: spark.createDataFrame([(f"{k}", n) for k in range(2)], "id string, size long")
    store.write("lengths", frame(0))
    then = store.snapshot()
    held = store.read("lengths", then)
    store.write_all({"lengths": (frame(1), "id")})
    assert {r["size"] for r in held.collect()} == {0} and {r["size"] for r in store.read("lengths").collect()} == {1}
    for n in range(2, 6):
        store.write("lengths", frame(n))
    assert {r["size"] for r in store.read("lengths").collect()} == {5}
    assert len(list((tmp_path / "s" / "lengths").iterdir())) <= KEPT + 2
    real = store.manifests.numbers
    store.manifests.numbers = lambda: real()[:-1]
    with pytest.raises(RuntimeError, match="written first"):
        store.write("lengths", frame(9))
    store.manifests.numbers = real
    assert {r["size"] for r in store.read("lengths").collect()} == {5}


def test_changes_leave_most_data_files(spark, tmp_path):
    """A change of one source file writes anew only the data files that hold its rows, whatever the table is clustered by."""
    from codestrata.operators.store import Replaced, Store

    store = Store(spark, str(tmp_path / "s"))
    names = [f.name for f in store.read("edges").schema.fields]
    edges = spark.range(4000).selectExpr("id", "'' from_id", "'' to_id", "concat('f', id) from_name", "lpad(string(id), 6, '0') to_name", "'calls' type", "concat('file', id div 10) file", "1 line").select(names)
    for by in ("file", "to_name"):
        store.write_all({"edges": (edges.repartition(8), by)})
        before = set(store.read("edges").inputFiles())
        new = edges.where("id = 0").selectExpr("id + 9000 id", "from_id", "to_id", "'new' from_name", "to_name", "type", "'file7' file", "line").select(names)
        store.write_all({"edges": (Replaced(spark.createDataFrame([("file7",), ("none",)], "file string"), new), by)})
        after = set(store.read("edges").inputFiles())
        if len(before) > 1:
            assert len(before & after) >= len(before) - 2, by
        want = sorted(r["id"] for r in edges.where("file <> 'file7'").collect()) + [9000]
        assert sorted(r["id"] for r in store.read("edges").collect()) == want
    store.write_all({"edges": (Replaced(spark.createDataFrame([("file8",)], "file string"), edges.limit(0)), "file")})
    assert store.read("edges").count() == 4000 - 10 + 1 - 10


def test_log_is_compacted(spark, tmp_path, monkeypatch):
    from codestrata.operators import store as stores

    monkeypatch.setattr(stores, "LOG_FILES", 3)
    store = stores.Store(spark, str(tmp_path / "s"))
    assert store.activity().count() == 0
    for k in range(4):
        store.log("search", f"q{k}", 1.0, 1, 2)
    assert [r["target"] for r in store.activity().orderBy("id").collect()] == [f"q{k}" for k in range(4)]
    assert len(store._log_files()) == 1 and len(store.activity().inputFiles()) == 2


def test_encoder_plugin(spark):
    rows = [("1", "a", "function", "x.py", 1, False, "def a()", "python"), ("2", "b", "function", "x.py", 2, False, "def b()", "python")]
    nodes = spark.createDataFrame(rows, NODE).withColumns({"docstring": F.lit(""), "body_preview": F.lit(""), "parent_class": F.lit("")})
    encoder = retrieval.Encoder("own", lambda: lambda texts: [[float(len(t)), float(t.count("b"))] for t in texts])
    vectors, vocab = retrieval.embed_nodes(nodes, encoder=encoder)
    got = {r["node_id"]: (list(r["vector"]), r["model"]) for r in vectors.collect()}
    texts = {r["id"]: r["text_input"] for r in retrieval.embedding_text(nodes).collect()}
    assert got == {k: ([float(len(t)), float(t.count("b"))], "own") for k, t in texts.items()} and vocab.count() == 0
    assert encoder.vector("abb") == [3.0, 2.0]
    # Of a text that stayed the stored vector stays; only the other is encoded.
    stored = vectors.withColumn("vector", F.array(F.lit(7.0).cast("float"))).withColumn("text_input", F.when(F.col("node_id") == "1", F.col("text_input")).otherwise("another"))
    again = {r["node_id"]: list(r["vector"]) for r in retrieval.embed_nodes(nodes, encoder=encoder, before=stored)[0].collect()}
    assert again == {"1": [7.0], "2": got["2"][0]}


def test_activity_of_nothing(spark):
    from codestrata.schemas import ACTIVITY

    row = cost.totals(spark.createDataFrame([], ACTIVITY)).first()
    assert (row["count"], row["tokens_saved"], row["time_saved_s"], row["avg_reduction"]) == (0, 0, 0.0, 0.0)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "shop").mkdir()
    (root / "shop" / "core.py").write_text("def price(x):\n    return tax(x)\n\ndef tax(x):\n    return x\n")
    (root / "shop" / "cart.py").write_text("from shop.core import price\n\ndef total(items):\n    return price(items)\n")
    (root / "test_cart.py").write_text("from shop.cart import total\n\ndef test_total():\n    assert total([]) == 0\n")
    made = Project(spark, str(root), str(tmp_path_factory.mktemp("store")))
    made.build()
    made.update()
    return made


def test_project(project):
    stats = project.stats()
    assert (stats["total_nodes"], stats["total_files"], stats["total_embeddings"]) == (4, 3, 4)
    blast = project.blast("shop/core.py")
    assert [x["function"] for x in blast["directly_affected"]] == ["total", "price"] or {x["function"] for x in blast["directly_affected"]} == {"total", "price"}
    assert [x["function"] for x in blast["indirectly_affected"]] == ["test_total"]
    assert "shop/cart.py" in blast["affected_files"] and blast["review_order"][0] == "1. shop/core.py (the change)"
    assert project.search("price", "keyword")["results"][0]["name"] == "price"
    assert project.search("total of items")["mode"] == "hybrid"
    assert project.terms.postings().count() > 0 and [r["name"] for r in project.search('"(x)', "keyword")["results"]] == []
    assert {r["name"] for r in project.search("(x)", "keyword")["results"]} >= {"price", "tax"}
    first = project.drawing(2)
    rest = project.drawing(10, first["nodes"][-1]["id"])
    assert len(first["nodes"]) == 2 and sorted(n["id"] for n in first["nodes"] + rest["nodes"]) == sorted(n["id"] for n in project.drawing()["nodes"])
    assert {r["from_name"] for r in project.query_graph("price")["callers"]} == {"total"}
    assert project.compare("shop/core.py")["files_without"] == 3
    log = project.activity()
    assert log["totals"]["count"] >= 4 and log["items"][0]["op"].startswith("query_graph")
    assert [s["files"] for s in project.scenarios()["scenarios"]] == [3, 1, 10, 3]


def test_rpc(project):
    out = io.StringIO()
    calls = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_stats", "arguments": {}}}, {"id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"id": 5, "method": "tools/call", "params": {"name": "get_blast_radius"}}]
    rpc.Server(project).run(["not json\n", *(json.dumps(c) + "\n" for c in calls)], out)
    answers = {a["id"]: a["result"] for a in map(json.loads, out.getvalue().splitlines())}
    assert set(answers) == {1, 2, 3, 4, 5} and len(answers[2]["tools"]) == 6
    assert json.loads(answers[3]["content"][0]["text"])["total_nodes"] == 4
    assert answers[4]["isError"] and answers[5]["isError"]


def test_http(project):
    made = server.make_server(project, 0)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{made.server_port}{path}", timeout=120).read()
    assert json.loads(get("/api/stats"))["total_nodes"] == 4
    assert json.loads(get("/api/blast")) == {"error": "No file specified"}
    pages = [json.loads(get("/api/nodes?limit=3")), json.loads(get("/api/edges?limit=1000"))]
    rest = json.loads(get(f"/api/nodes?limit=3&after={pages[0][-1]['id']}"))
    assert len(pages[0]) == 3 and len(rest) == 1 and len(pages[1]) == len(json.loads(get("/api/edges")))
    assert len(json.loads(get("/api/graph"))["nodes"]) == 4 and b"codestrata" in get("/")
    made.shutdown()


def test_updates(project):
    root = project.root
    import os

    os.rename(f"{root}/shop/core.py", f"{root}/shop/money.py")
    with open(f"{root}/shop/cart.py", "a") as file:
        file.write("\ndef extra():\n    return tax(1)\n")
    ids = {r["name"]: r["id"] for r in project.nodes.collect()}
    assert project.update() == {"changed": 1, "deleted": 0, "renamed": 1}
    now = {r["name"]: r for r in project.nodes.collect()}
    assert now["price"]["file"] == "shop/money.py" and now["price"]["id"] == ids["price"]
    edge = project.resolved.where("type = 'calls' and from_name = 'extra'").first()
    assert edge["to_id"] == ids["tax"]
    assert {r["name"] for r in project.search("money", "keyword")["results"]} == {"price", "tax"}  # the renamed file is indexed
    assert len(project.terms.segments()) == 2 and isinstance(project.store.snapshot()["nodes"], list) and project.edges.count() == project.edges.select("id").distinct().count()
    os.remove(f"{root}/test_cart.py")
    assert project.update() == {"changed": 0, "deleted": 1, "renamed": 0}
    assert "test_total" not in {r["name"] for r in project.nodes.collect()} and project.update() == {"changed": 0, "deleted": 0, "renamed": 0}
