"""The tree walk on a hand-made tree, and the SQL table functions."""

from codestrata.functions.tables import register_graph
from codestrata.operators import syntax
from codestrata.plans import binding


class Leaf:
    """A node of a syntax tree: type, byte range, points, children."""

    def __init__(self, source, kind, text=None, children=()):
        self.type, self.children = kind, list(children)
        self.start_byte = source.find(text) if text else (self.children[0].start_byte if self.children else 0)
        self.end_byte = self.start_byte + len(text) if text else (self.children[-1].end_byte if self.children else 0)
        self.start_point = (source[: self.start_byte].count("\n"), 0)
        self.end_point = (source[: self.end_byte].count("\n"), 0)


SOURCE = 'import os.path\nclass Box:\n    def put(self):\n        """Puts."""\n        self.store.save(1)\n        helper()\n        print()\n'


def tree():
    n = lambda kind, text=None, *children: Leaf(SOURCE, kind, text, children)
    method_call = n("call", None, n("attribute", None, n("identifier", "self.store"[5:]), n("identifier", "save")), n("argument_list", "(1)"))
    block = n("block", None, n("expression_statement", None, n("string", '"""Puts."""')), n("expression_statement", None, method_call), n("expression_statement", None, n("call", None, n("identifier", "helper"))), n("expression_statement", None, n("call", None, n("identifier", "print"))))
    put = n("function_definition", None, n("def", "def"), n("identifier", "put"), block)
    box = n("class_definition", None, n("class", "class"), n("identifier", "Box"), put)
    return n("module", None, n("import_statement", None, n("import", "import"), n("dotted_name", "os.path")), box)


class Parser:
    def parse(self, data):
        assert data.decode() == SOURCE
        return type("Tree", (), {"root_node": tree()})


def test_tree_rows():
    made = syntax.rows_of("python", "pkg/test_box.py", SOURCE, "h", tree())
    assert [(n["name"], n["type"], n["line"], n["parent_class"], n["docstring"], n["is_test"]) for n in made["nodes"]] == [("Box", "class", 2, "", "", False), ("put", "function", 3, "Box", "Puts.", True)]
    assert [(e["type"], e["from_name"], e["to_name"], e["line"]) for e in made["edges"]] == [("imports", "pkg.test_box", "os.path", 1), ("member_of", "put", "Box", 3), ("calls", "put", "save", 5), ("calls", "put", "helper", 6)]
    assert made["nodes"][1]["end_line"] >= 6 and made["nodes"][1]["signature"] == "def put(self):"


def test_grammars():
    known = syntax.GRAMMARS
    assert len(known) == 21 and known["go"].class_name == ["type_spec", "type_identifier"] and known["lua"].imports == []


def test_each_file_is_parsed_once(spark, tmp_path):
    """Nodes and edges come from one parse where the parsed rows are kept; node ids do not repeat."""
    sources = spark.createDataFrame([("pkg/test_box.py", "python", SOURCE, "h"), ("x.zig", "zig", "", "h")], "file string, language string, source string, sha256 string")
    parses = spark.sparkContext.accumulator(0)

    class Counted(Parser):
        def parse(self, data):
            parses.add(1)
            return super().parse(data)

    def keep(df):
        df.write.parquet(str(tmp_path / "parsed"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / "parsed"))

    nodes, edges = syntax.parse_trees(sources, lambda language: Counted(), keep)
    assert {r["name"] for r in nodes.collect()} == {"Box", "put"} and edges.count() == 4 and parses.value == 1
    assert nodes.select("id").distinct().count() == 2 and nodes.where("length(id) = 12").count() == 2


def test_without_a_library(spark):
    sources = spark.createDataFrame([("a.py", "python", "def f():\n    g()\n", "h")], "file string, language string, source string, sha256 string")
    nodes, edges = syntax.parse_best(sources)
    assert nodes.count() == 1 and edges.count() == 1
    nodes, edges = syntax.parse_trees(sources, lambda language: None)
    assert nodes.count() == 0 and edges.count() == 0


def test_table_functions(spark):
    d = "/root/testdata/sf0.001"
    nodes, edges = binding.nodes(spark, d), binding.edges(spark, d)
    register_graph(spark, nodes, edges)
    name = edges.where("type = 'calls'").first()["to_name"]
    assert spark.sql(f"select * from graph_callers('{name}')").count() == edges.where(f"type = 'calls' and to_name = '{name}'").select("from_name", "file", "line").distinct().count()
    assert spark.sql("select * from graph_dependents('NATION_3')").count() >= 1
    assert spark.sql(f"select f.name, c.to_name from graph_nodes f, lateral graph_callees(f.name) c where f.name = '{name}'").count() >= 0
