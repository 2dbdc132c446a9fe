"""Extraction from syntax trees, where a tree-sitter library is installed.

A parser per worker and language, found once, gives a file's tree. One pass over
the tree notes what matters (definitions, imports, calls) with its span of bytes;
what a note stands in follows from the spans alone: the innermost class and the
innermost function that are still open where it begins. A file gives one row
with its nodes and edges as arrays, in the columns of the line parsers, so
resolution and all that follows are shared. Trees give end lines and do not look
into comments; they give no inheritance and no test edges.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codestrata.functions import text as X
from codestrata.operators.extract import CALL_DENYLIST, EDGE_COLUMNS, NODE_COLUMNS, parse


@dataclass(frozen=True)
class Grammar:
    """Types of syntax nodes by what they mean. A name's path: the type of the child that holds it, and of that child's child."""

    module: str
    functions: list[str]
    calls: list[str]
    function_name: list[str]
    class_name: list[str]
    classes: list[str] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    #: Test files by name, test functions by prefix ("test_*") or name, calls that are imports.
    test_files: list[str] = field(default_factory=list)
    test_functions: list[str] = field(default_factory=list)
    import_calls: list[str] = field(default_factory=list)


# The types that the languages' grammars use.
GRAMMARS = {
    "python": Grammar(
        module="tree_sitter_python",
        functions=["function_definition"],
        classes=["class_definition"],
        imports=["import_statement", "import_from_statement"],
        calls=["call"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["test_*.py", "*_test.py"],
        test_functions=["test_*"],
    ),
    "javascript": Grammar(
        module="tree_sitter_javascript",
        functions=["function_declaration", "arrow_function", "method_definition", "generator_function_declaration"],
        classes=["class_declaration"],
        imports=["import_statement"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["*.test.js", "*.spec.js", "test_*.js"],
        test_functions=["describe", "it", "test"],
    ),
    "typescript": Grammar(
        module="tree_sitter_typescript",
        functions=["function_declaration", "arrow_function", "method_definition"],
        classes=["class_declaration", "interface_declaration"],
        imports=["import_statement"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["type_identifier"],
        test_files=["*.test.ts", "*.spec.ts"],
        test_functions=["describe", "it", "test"],
    ),
    "tsx": Grammar(
        module="tree_sitter_tsx",
        functions=["function_declaration", "arrow_function", "method_definition"],
        classes=["class_declaration", "interface_declaration"],
        imports=["import_statement"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["type_identifier"],
        test_files=["*.test.tsx", "*.spec.tsx"],
        test_functions=["describe", "it", "test"],
    ),
    "go": Grammar(
        module="tree_sitter_go",
        functions=["function_declaration", "method_declaration"],
        classes=["type_declaration"],
        imports=["import_declaration"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["type_spec", "type_identifier"],
        test_files=["*_test.go"],
        test_functions=["Test*", "Benchmark*"],
    ),
    "rust": Grammar(
        module="tree_sitter_rust",
        functions=["function_item"],
        classes=["struct_item", "impl_item", "enum_item", "trait_item"],
        imports=["use_declaration"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["type_identifier"],
    ),
    "java": Grammar(
        module="tree_sitter_java",
        functions=["method_declaration", "constructor_declaration"],
        classes=["class_declaration", "interface_declaration", "enum_declaration"],
        imports=["import_declaration"],
        calls=["method_invocation"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["*Test.java", "*Tests.java"],
    ),
    "csharp": Grammar(
        module="tree_sitter_c_sharp",
        functions=["method_declaration", "constructor_declaration"],
        classes=["class_declaration", "interface_declaration", "struct_declaration"],
        imports=["using_directive"],
        calls=["invocation_expression"],
        function_name=["identifier"],
        class_name=["identifier"],
    ),
    "ruby": Grammar(
        module="tree_sitter_ruby",
        functions=["method", "singleton_method"],
        classes=["class", "module"],
        imports=["call"],
        calls=["call", "command_call"],
        function_name=["identifier"],
        class_name=["constant"],
        test_files=["*_test.rb", "test_*.rb", "*_spec.rb"],
        test_functions=["describe", "it", "context"],
        import_calls=["require", "require_relative"],
    ),
    "kotlin": Grammar(
        module="tree_sitter_kotlin",
        functions=["function_declaration"],
        classes=["class_declaration", "object_declaration"],
        imports=["import_header"],
        calls=["call_expression"],
        function_name=["simple_identifier"],
        class_name=["type_identifier"],
    ),
    "swift": Grammar(
        module="tree_sitter_swift",
        functions=["function_declaration"],
        classes=["class_declaration", "struct_declaration", "protocol_declaration"],
        imports=["import_declaration"],
        calls=["call_expression"],
        function_name=["simple_identifier"],
        class_name=["type_identifier"],
        test_functions=["test*"],
    ),
    "php": Grammar(
        module="tree_sitter_php",
        functions=["function_definition", "method_declaration"],
        classes=["class_declaration", "interface_declaration", "trait_declaration"],
        imports=["use_declaration", "namespace_use_declaration"],
        calls=["function_call_expression", "member_call_expression"],
        function_name=["name"],
        class_name=["name"],
        test_files=["*Test.php"],
        test_functions=["test*"],
    ),
    "solidity": Grammar(
        module="tree_sitter_solidity",
        functions=["function_definition"],
        classes=["contract_declaration", "interface_declaration", "library_declaration"],
        imports=["import_directive"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["*.t.sol"],
        test_functions=["test*"],
    ),
    "c": Grammar(
        module="tree_sitter_c",
        functions=["function_definition"],
        classes=["struct_specifier", "enum_specifier", "union_specifier"],
        imports=["preproc_include"],
        calls=["call_expression"],
        function_name=["function_declarator", "identifier"],
        class_name=["type_identifier"],
        test_files=["test_*.c", "*_test.c"],
        test_functions=["test_*"],
    ),
    "cpp": Grammar(
        module="tree_sitter_cpp",
        functions=["function_definition"],
        classes=["class_specifier", "struct_specifier"],
        imports=["preproc_include"],
        calls=["call_expression"],
        function_name=["function_declarator", "identifier"],
        class_name=["type_identifier"],
        test_functions=["TEST", "TEST_F", "TEST_P"],
    ),
    "dart": Grammar(
        module="tree_sitter_dart",
        functions=["function_signature", "method_signature"],
        classes=["class_definition"],
        imports=["import_or_export"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["*_test.dart"],
        test_functions=["test", "group"],
    ),
    "scala": Grammar(
        module="tree_sitter_scala",
        functions=["function_definition"],
        classes=["class_definition", "object_definition", "trait_definition"],
        imports=["import_declaration"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["identifier"],
    ),
    "r": Grammar(
        module="tree_sitter_r",
        functions=["function_definition"],
        imports=["call"],
        calls=["call"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["test-*.R", "test_*.R"],
        test_functions=["test_that", "expect_equal"],
        import_calls=["library", "require", "source"],
    ),
    "perl": Grammar(
        module="tree_sitter_perl",
        functions=["function_definition"],
        imports=["use_statement"],
        calls=["call"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["*.t"],
        test_functions=["ok", "is", "like", "done_testing"],
    ),
    "lua": Grammar(
        module="tree_sitter_lua",
        functions=["function_declaration", "local_function"],
        calls=["function_call"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["*_spec.lua", "test_*.lua"],
        test_functions=["describe", "it"],
        import_calls=["require", "dofile"],
    ),
    "vue": Grammar(
        module="tree_sitter_vue",
        functions=["function_declaration", "arrow_function", "method_definition"],
        classes=["class_declaration"],
        imports=["import_statement"],
        calls=["call_expression"],
        function_name=["identifier"],
        class_name=["identifier"],
        test_files=["*.test.vue", "*.spec.vue"],
    ),
}
# Types of names, of dotted names and their parts, of what an import names.
NAMES = ["identifier", "type_identifier", "property_identifier", "name"]
DOTTED = ["attribute", "member_expression", "field_expression", "selector_expression", "scoped_identifier"]
MEMBERS = ["identifier", "property_identifier", "field_identifier", "type_identifier"]
MODULES = ["dotted_name", "module_path", "scoped_identifier", "namespace_use_path", "identifier"]
STRINGS = ["string", "interpreted_string_literal", "raw_string_literal"]

_NODE = "id string, name string, type string, language string, file string, line int, end_line int, signature string, docstring string, sha256 string, is_test boolean, parent_class string, body_preview string"
_EDGE = "from_id string, to_id string, from_name string, to_name string, type string, file string, line int, part int, place int"
_FILE = f"nodes array<struct<{_NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{_EDGE.replace(' ', ':').replace(',:', ',')}>>"
_DENIED = frozenset(CALL_DENYLIST)


# --- parsers --------------------------------------------------------------------------------------

_parsers: dict[str, Any] = {}


def parser_for(language: str) -> Any:
    """This process's parser of a language, or None: from a bundle of languages, else from the language's own module."""
    if language not in _parsers:
        _parsers[language] = _bundled(language) or _single(language)
    return _parsers[language]


def _bundled(language: str) -> Any:
    try:
        return importlib.import_module("tree_sitter_languages").get_parser(language)
    except Exception:  # the bundle or the language is missing
        return None


def _single(language: str) -> Any:
    try:
        core, module = importlib.import_module("tree_sitter"), importlib.import_module(GRAMMARS[language].module)
    except (ImportError, KeyError):
        return None
    made = module.language() if callable(module.language) else module.language
    try:
        return core.Parser(core.Language(made))
    except TypeError:  # an older interface
        parser = core.Parser()
        parser.set_language(core.Language(made))
        return parser


def available() -> bool:
    """Whether any tree-sitter library can be imported here."""
    return any(importlib.util.find_spec(m) for m in ("tree_sitter_languages", "tree_sitter"))


# --- notes of a tree ------------------------------------------------------------------------------


class Note(NamedTuple):
    """What a syntax node means: ``kind`` function, class, import or call; ``name``; where it stands."""

    kind: str
    name: str
    at: Any


def preorder(root: Any) -> Iterator[Any]:
    """All syntax nodes, each before what is inside it."""
    left = [root]
    while left:
        at = left.pop()
        yield at
        left += reversed(at.children)


def of_type(at: Any, types: list[str]) -> list[Any]:
    """The children of these types."""
    return [c for c in at.children if c.type in types]


def descend(at: Any, *steps: list[str]) -> Any:
    """The first child of the first step's types, its first child of the second's, and so on; None where one is missing."""
    for types in steps:
        found = of_type(at, types) if at is not None else []
        at = found[0] if found else None
    return at


class Reader:
    """The texts of one file's tree."""

    def __init__(self, grammar: Grammar, data: bytes):
        self.grammar, self.data = grammar, data

    def text(self, at: Any) -> str:
        return self.data[at.start_byte : at.end_byte].decode("utf-8", "replace") if at is not None else ""

    def name_of(self, at: Any, path: list[str]) -> str:
        """By the grammar's path, as far as it leads; else the first name."""
        ends = (descend(at, *([step] for step in path[:k])) for k in range(len(path), 0, -1))
        return self.text(next((e for e in ends if e is not None), descend(at, NAMES)))

    def callee_of(self, at: Any) -> str:
        """A plain name, or the last part of a dotted one, whichever child comes first."""
        ends = ((of_type(c, MEMBERS) if c.type in DOTTED else [c])[-1:] for c in of_type(at, ["identifier", *DOTTED]))
        return self.text(next((e[0] for e in ends if e), None))

    def module_of(self, at: Any) -> str:
        """What an import names; of calls that may be imports, only those by the language's names."""
        caller = descend(at, ["identifier"])
        if self.grammar.import_calls and caller is not None and self.text(caller) not in self.grammar.import_calls:
            return ""
        named = descend(at, MODULES + STRINGS)
        return self.text(named).strip("\"'`" if named is not None and named.type in STRINGS else "")

    def notes(self, root: Any) -> Iterator[Note]:
        g = self.grammar
        for at in preorder(root):
            kind, name = "", ""
            if at.type in g.functions:
                kind, name = "function", self.name_of(at, g.function_name)
            elif at.type in g.classes:
                kind, name = "class", self.name_of(at, g.class_name)
            if name:
                yield Note(kind, name, at)
                continue
            if at.type in g.imports and (module := self.module_of(at)):
                yield Note("import", module, at)
            if at.type in g.calls and (callee := self.callee_of(at)) not in _DENIED and callee:
                yield Note("call", callee, at)


def rows_of(language: str, file: str, source: str, sha256: str, root: Any) -> dict[str, list[dict]]:
    """A file's ``nodes`` and ``edges`` from its tree's notes."""
    grammar = GRAMMARS[language]
    reader, lines = Reader(grammar, source.encode("utf-8", "replace")), source.split("\n")
    in_test_file = any(fnmatch(file.rpartition("/")[2], p) for p in grammar.test_files)
    nodes: list[dict] = []
    edges: list[dict] = []

    def edge(kind: str, source_name: str, target: str, line: int) -> None:
        edges.append({"from_id": "", "to_id": "", "from_name": source_name, "to_name": target, "type": kind, "file": file, "line": line, "part": 0, "place": len(edges)})

    inside: list[Note] = []  # the definitions that are open, outermost first
    for note in reader.notes(root):
        while inside and inside[-1].at.end_byte <= note.at.start_byte:
            inside.pop()
        around = {d.kind: d.name for d in inside}  # the innermost of each kind comes last
        begin, end = note.at.start_point[0], note.at.end_point[0]
        if note.kind in ("function", "class"):
            made = dict.fromkeys(("id", "docstring", "parent_class", "body_preview"), "") | {"name": note.name, "type": note.kind, "language": language, "file": file, "line": begin + 1, "end_line": end + 1}
            made |= {"signature": lines[begin][:160].strip(), "sha256": sha256, "is_test": False}
            if note.kind == "function":
                said = descend(note.at, ["block"], ["expression_statement"], ["string"]) if language == "python" else None
                body = filter(None, (x.strip() for x in lines[begin + 1 : end][:15]))
                made |= {"docstring": reader.text(said).strip("\"'").strip()[:500], "parent_class": around.get("class", ""), "body_preview": " ".join(body)[:300]}
                made["is_test"] = in_test_file or any(fnmatch(note.name, p) for p in grammar.test_functions)
                if made["parent_class"]:
                    edge("member_of", note.name, made["parent_class"], begin + 1)
            nodes.append(made)
            inside.append(note)
        elif note.kind == "import":
            edge("imports", (file.rpartition(".")[0] or file).replace("/", "."), note.name, begin + 1)
        elif "function" in around:
            edge("calls", around["function"], note.name, begin + 1)
    return {"nodes": nodes, "edges": edges}


# --- tables ---------------------------------------------------------------------------------------


def parse_trees(sources: DataFrame, parser: Callable[[str], Any] = parser_for, keep: Callable[[DataFrame], DataFrame] = lambda parsed: parsed) -> tuple[DataFrame, DataFrame]:
    """Nodes and unresolved edges of the files whose language has a tree parser.

    ``keep`` writes the parsed files (and returns a scan of them), where both
    tables are wanted and each file should be parsed once.
    """
    kind = _parse_datatype_string(_FILE)
    wanted = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                found = parser(row["language"]) if row["language"] in GRAMMARS else None
                if found is not None:
                    made.append(rows_of(**row, root=found.parse(row["source"].encode("utf-8", "replace")).root_node))
            yield pa.RecordBatch.from_pylist(made, schema=wanted)

    parsed = keep(sources.select("language", "file", "source", "sha256").mapInArrow(run, kind))
    nodes = parsed.select(F.explode("nodes").alias("r")).select("r.*")
    nodes = nodes.withColumn("id", X.node_id(F.col("file"), F.col("name"), F.col("line"))).dropDuplicates(["id"])
    return nodes.select(NODE_COLUMNS), parsed.select(F.explode("edges").alias("r")).select("r.*").select(EDGE_COLUMNS)


def parse_best(sources: DataFrame, languages: set[str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda parsed: parsed) -> tuple[DataFrame, DataFrame]:
    """Trees for the languages that have a parser here, line rules for the others; ``languages``: those present, if known."""
    with_trees = [name for name in GRAMMARS if available() and parser_for(name) is not None]
    if not with_trees:
        return parse(sources, languages)
    by_tree = parse_trees(sources.where(F.col("language").isin(with_trees)), keep=keep)
    by_line = parse(sources.where(~F.col("language").isin(with_trees)), languages and languages - set(with_trees))
    return by_tree[0].unionByName(by_line[0]), by_tree[1].unionByName(by_line[1])
