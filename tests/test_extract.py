"""Parsers against small sources with results derived by hand, and against a plain line scanner."""

import random
import re

import pytest

from codestrata.functions.languages import language_of
from codestrata.functions import folds
from codestrata.operators import extract
from codestrata.sources import trees
from pyspark.sql import functions as F

PY = '''import os, sys
from auth.tokens import make as build, check
from . import near
class Store(Base, object, Mixin):
    """Keeps things.
    More.
    """
    def save(self, item) -> bool:
        # helper(9)
        self.write_row(item)
        _hidden(item)
        __magic(item)
        save(1)
        print(item)
        getattr(item, 'flush')
        return helper(item)

    async def load(self):
        "no docstring"
        return rows(1)

def plain():
    \'\'\'One line.\'\'\'
    def nested(x):
        return inner(x)
    return outer()

def broken(a,
           b):
    return other(a)
left(1)
'''
JS = """import { a } from './lib'
export async function fetchAll(x, y) {
const go = async (z) => {
  if (x) {
class Big extends Small {
  run(k) {
    fetchAll(k); unknown(k)
"""
GO = 'package x\nimport (\n  "fmt"\n)\nfunc (s *Server) Run(a int) {\nfunc TestRun(t *T) {\ntype Server struct {\n x := "later/thing"\n'
JAVA = "import a.b.C;\npublic class FooTest extends Base {\n  @Test\n  public void checks(int a) {\n  private static List<String> names() {\n"
RUST = "use std::io;\n#[test]\n// note\nfn first(a: u8) {}\nfn second() {}\nmod tests {\nfn third<T>(x: T) {}\npub struct Thing;\n"
KT = "class Box {\n  fun open(a: Int) {\n  private val x = call(1)\n}\n"


def sources(spark, *files):
    df = spark.createDataFrame(list(files), "file string, source string")
    return trees.with_hash(df).withColumn("language", language_of(F.col("file"))).select("file", "language", "source", "sha256")


@pytest.fixture(scope="module")
def parsed(spark):
    made = sources(spark, ("pkg/store.py", PY), ("src/app.js", JS), ("run_test.go", GO), ("FooTest.java", JAVA), ("lib.rs", RUST), ("Box.kt", KT))
    nodes, edges = extract.parse(made)
    return [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()]


def of(parsed, file):
    nodes, edges = parsed
    return {n["name"]: n for n in nodes if n["file"] == file}, [(e["type"], e["from_name"], e["to_name"], e["line"]) for e in sorted((e for e in edges if e["file"] == file), key=lambda e: (e["part"], e["line"], e["place"]))]


def test_python(parsed):
    nodes, edges = of(parsed, "pkg/store.py")
    assert set(nodes) == {"Store", "save", "load", "plain", "nested"}
    assert nodes["Store"]["signature"] == "class Store(Base, object, Mixin)" and nodes["Store"]["docstring"] == "Keeps things. More."
    assert nodes["save"]["parent_class"] == "Store" and nodes["save"]["signature"] == "def save(self, item) -> bool"
    assert nodes["load"]["signature"] == "async def load(self)" and nodes["load"]["parent_class"] == "Store"
    assert nodes["plain"]["docstring"] == "One line." and nodes["plain"]["parent_class"] == ""
    assert nodes["nested"]["parent_class"] == ""
    assert nodes["save"]["body_preview"].startswith("self.write_row(item) _hidden(item)")
    assert len(nodes["save"]["sha256"]) == 16 and len(nodes["save"]["id"]) == 12
    kinds = lambda k: [(e[1], e[2], e[3]) for e in edges if e[0] == k]
    assert kinds("inherits") == [("Store", "Base", 4), ("Store", "Mixin", 4)]
    assert kinds("member_of") == [("save", "Store", 8), ("load", "Store", 18)]
    assert kinds("imports") == [("pkg.store", "os", 1), ("pkg.store", "auth.tokens.make", 2), ("pkg.store", "auth.tokens.check", 2), ("pkg.store", "..near", 3)]
    # Comments count, private and own names do not, dunders do, denied names do not; a multi-line def opens a scope without a node.
    assert kinds("calls") == [("save", "helper", 9), ("save", "write_row", 10), ("save", "__magic", 12), ("save", "flush", 15), ("save", "helper", 16), ("load", "rows", 20), ("nested", "inner", 25), ("broken", "other", 30)]


def test_test_edges(spark):
    text = "class TestAll:\n    def test_one(self):\n        run(1)\n        run(2)\n    def helper(self):\n        go()\n"
    nodes, edges = extract.parse(sources(spark, ("test_x.py", text)))
    assert {(n["name"], n["is_test"]) for n in nodes.collect()} == {("TestAll", True), ("test_one", True), ("helper", False)}
    assert [(e["from_name"], e["to_name"], e["line"]) for e in edges.where("type = 'tests'").collect()] == [("test_one", "run", 2)] * 2


def test_scripts(parsed):
    nodes, edges = of(parsed, "src/app.js")
    assert set(nodes) == {"fetchAll", "go", "Big", "run"}
    assert nodes["fetchAll"]["signature"] == "function fetchAll(x, y)" and nodes["Big"]["signature"] == "class Big extends Small"
    assert ("imports", "src/app.js", "./lib", 1) in edges and ("inherits", "Big", "Small", 5) in edges
    assert ("calls", "", "fetchAll", 7) in edges and not any(e[2] == "unknown" for e in edges)


def test_go(parsed):
    nodes, edges = of(parsed, "run_test.go")
    assert nodes["Run"]["signature"] == "func (s Server) Run(a int)" and nodes["Run"]["parent_class"] == "Server"
    assert nodes["TestRun"]["is_test"] and nodes["Server"]["type"] == "class"
    assert [e for e in edges if e[0] == "imports"] == [("imports", "run_test.go", "fmt", 3), ("imports", "run_test.go", "later/thing", 8)]


def test_java(parsed):
    nodes, edges = of(parsed, "FooTest.java")
    assert nodes["checks"]["is_test"] and not nodes["names"]["is_test"] and nodes["FooTest"]["is_test"]
    assert edges == [("inherits", "FooTest", "Base", 2), ("imports", "FooTest.java", "a.b.C", 1)] or set(edges) == {("inherits", "FooTest", "Base", 2), ("imports", "FooTest.java", "a.b.C", 1)}


def test_rust(parsed):
    nodes, edges = of(parsed, "lib.rs")
    assert {k: n["is_test"] for k, n in nodes.items()} == {"first": True, "second": False, "third": True, "Thing": False}
    assert edges == [("imports", "lib.rs", "std::io", 1)]


def test_generic(parsed):
    nodes, edges = of(parsed, "Box.kt")
    assert nodes["Box"]["type"] == "class" and nodes["open"]["type"] == "function" and edges == []


def test_resolution_fans_out(spark):
    nodes = spark.createDataFrame([("1", "f"), ("2", "f"), ("3", "g")], "id string, name string")
    edges = spark.createDataFrame([("calls", "f", ""), ("calls", "x", ""), ("imports", "f", "")], "type string, to_name string, to_id string")
    assert sorted(map(tuple, extract.resolve(nodes, edges).collect())) == [("calls", "f", "1"), ("calls", "f", "2"), ("calls", "x", ""), ("imports", "f", "")]


def plain_scan(text):
    """Calls and parents of a Python source by walking its lines."""
    calls, parents, cls, cls_indent, fn, fn_indent = [], [], None, 0, None, 0
    for k, line in enumerate(text.split("\n"), 1):
        left = line.lstrip()
        indent = len(line) - len(left)
        m = re.match(r"class\s+(\w+)\s*:", left)
        d = re.match(r"def\s+(\w+)\(\):", left)
        if m:
            cls, cls_indent = m[1], indent
        elif d:
            if not (cls and indent > cls_indent):
                cls = None
            parents.append((d[1], cls or "", k))
        if d:
            fn, fn_indent = d[1], indent
            continue
        if fn and left and not left.startswith("#") and indent <= fn_indent:
            fn = None
        if fn:
            calls += [(fn, c, k) for c in re.findall(r"(\w+)\(", left) if c != fn]
    return calls, parents


def test_contexts_like_a_line_scanner(spark):
    random.seed(11)
    files = []
    for k in range(40):
        lines = [" " * random.choice([0, 0, 4, 4, 8]) + random.choice(["class Aa:", "class Bb:", "def ff():", "def gg():", "xx(1)", "yy(2) + zz(3)", "# cc(1)", "", "stop"]) for _ in range(random.randint(0, 25))]
        files.append((f"m{k}.py", "\n".join(lines)))
    nodes, edges = extract.parse(sources(spark, *files))
    got_calls = sorted((e["file"], e["from_name"], e["to_name"], e["line"]) for e in edges.where("type = 'calls'").collect())
    got_parents = sorted((n["file"], n["name"], n["parent_class"], n["line"]) for n in nodes.where("type = 'function'").collect())
    want = [(f, plain_scan(t)) for f, t in files]
    assert got_calls == sorted((f, *c) for f, (calls, _) in want for c in calls)
    assert got_parents == sorted((f, *p) for f, (_, parents) in want for p in parents)


def test_tree(spark, tmp_path):
    for name, content in {"a/__init__.py": b"x = 1\r\ny\xff = 2", "node_modules/b.py": b"", "c/d.PY": b"", "e.txt": b"", "f_pb2.py": b"", "g.py": b"# Generated by x", "migrations/0001_a.py": b"", "h.generated.js": b""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    found = {r["file"]: r for r in trees.read_sources(spark, str(tmp_path)).collect()}
    assert set(found) == {"a/__init__.py", "c/d.PY"}
    assert found["a/__init__.py"]["source"] == "x = 1\ny = 2"
    assert {r["file"] for r in trees.scan_hashes(spark, f"file://{tmp_path}").collect()} == {"a/__init__.py", "c/d.PY", "f_pb2.py", "g.py", "migrations/0001_a.py", "h.generated.js"}


def test_context_over_long_files(spark):
    """A file of many pieces keeps its context from one piece to the next, and extraction shuffles nothing."""
    body = "".join(f"        step{k}()\n" for k in range(3 * folds.PIECE))
    source = f"class A:\n    def first(self):\n{body}    def second(self):\n        last()\ndef third():\n    self_made()\n"
    rows = spark.createDataFrame([("a.py", "python", source, "h"), ("b.py", "python", "", "h"), ("c.py", "python", None, "h")], "file string, language string, source string, sha256 string")
    nodes, edges = extract.parse(rows, {"python"})
    assert {(r["name"], r["parent_class"]) for r in nodes.collect()} == {("A", ""), ("first", "A"), ("second", "A"), ("third", "")}
    calls = [(r["from_name"], r["to_name"]) for r in edges.where("type = 'calls'").collect()]
    assert len(calls) == 3 * folds.PIECE + 2 and set(calls[: 3 * folds.PIECE]) == {("first", f"step{k}") for k in range(3 * folds.PIECE)} and {("second", "last"), ("third", "self_made")} < set(calls)
    for language in ({"python"}, {"javascript"}, {"java"}, {"rust"}, {"go"}):
        for table in extract.parse(rows, language):
            assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()


def test_tests_of_repeated_names(spark):
    """Each test of a name gets the calls of all functions of that name, as the rows of the file have it."""
    source = "def test_a():\n    x1()\n    x2()\n\ndef test_b():\n    x3()\n\ndef test_a():\n    x4()\n"
    rows = spark.createDataFrame([("test_m.py", "python", source, "h")], "file string, language string, source string, sha256 string")
    found = extract.parse(rows, {"python"})[1].where("type = 'tests'").collect()
    assert sorted((r["line"], r["from_name"], r["to_name"]) for r in found) == sorted([(n, "test_a", f"x{k}") for n in (1, 8) for k in (1, 2, 4)] + [(5, "test_b", "x3")])


def test_tree_source(spark, tmp_path, monkeypatch):
    """Every file comes once whatever the number of folders; languages and paths reach the listing."""
    from codestrata.sources import tree_source

    want = {}
    for k in range(60):
        folder = tmp_path / f"a{k % 3}" / f"b{k % 5}" / ("vendor" if k % 20 == 19 else f"c{k % 2}")
        folder.mkdir(parents=True, exist_ok=True)
        name = f"m{k}.{['py', 'GO', 'txt'][k % 3]}"
        (folder / name).write_text(f"x{k}")
        if k % 3 < 2 and k % 20 != 19:
            want[str((folder / name).relative_to(tmp_path))] = ("python" if k % 3 == 0 else "go", f"x{k}".encode())
    (tmp_path / "__init__.py").write_text("")
    want["__init__.py"] = ("python", b"")
    reader = tree_source.TreeReader(str(tmp_path), ["vendor"], True)
    for folders in (1, 2, 7, 1000):
        monkeypatch.setattr(tree_source, "FOLDERS", folders)
        monkeypatch.setattr(tree_source, "NAMES", 4)
        rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        assert len(rows) == len(want) and {r["file"]: (r["language"], r["content"]) for r in rows} == want
    found = tree_source.load(spark, str(tmp_path), ["vendor"])
    assert {r["file"]: (r["language"], bytes(r["content"])) for r in found.collect()} == want
    some = tree_source.load(spark, str(tmp_path), ["vendor"], languages=["go"], prefix="a1/b")
    assert {r["file"] for r in some.collect()} == {f for f, (language, _) in want.items() if language == "go" and f.startswith("a1/b")}
    name = next(f for f in want if f.startswith("a1"))
    assert [r["file"] for r in tree_source.load(spark, str(tmp_path), [], prefix=name).collect()] == [name]
    assert found.where("language = 'go'").count() < found.count() == len(want)
    assert trees.languages_in(spark, str(tmp_path)) == {"python", "go"}
    (tmp_path / "none").mkdir()
    assert tree_source.load(spark, str(tmp_path / "none"), []).count() == 0
