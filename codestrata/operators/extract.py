"""Source texts to graph rows: arrays of lines, regular expressions, and folds inside a file's row.

Every parser takes (file, language, source, sha256) and gives nodes and edges as
lazy plans. What a line needs of the lines before it (the class, the function, an
attribute) is the state of a fold over the file's array of lines, what it needs
of others a slice of the array; so extraction has no shuffle at all. Regular
expressions run in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import folds
from codestrata.functions import text as X
from codestrata.functions.languages import OWN_PARSER

# Names that look like calls but are no edges of a project.
CALL_DENYLIST = """
print len str int float list dict set tuple range enumerate isinstance hasattr getattr setattr delattr super type bool any all map filter
sorted reversed zip abs round max min sum next iter hash id vars dir repr bytes bytearray object property classmethod staticmethod
open input format chr ord
append extend insert remove pop clear copy update get items keys values setdefault split join strip lstrip rstrip replace
lower upper title startswith endswith find includes indexOf slice substring trim trimStart trimEnd encode decode read write close seek tell
loads dumps load dump match search findall sub compile time sleep now strftime strptime post put delete
ValueError TypeError KeyError IndexError AttributeError RuntimeError Exception PermissionError NotImplementedError
StopIteration OSError IOError FileNotFoundError ImportError NameError AssertionError ZeroDivisionError OverflowError MemoryError RecursionError
assertEqual assertRaises assertTrue assertFalse assertIsNone assertIsNotNone assertIn assertNotIn setUp tearDown mock patch MagicMock
""".split()
# Bases that are no inheritance, and keywords that a pattern may take for names.
PLAIN_BASES = ["object", "ABC"]
SCRIPT_KEYWORDS = ["if", "for", "while", "switch", "catch", "class", "return"]
METHOD_KEYWORDS = ["if", "for", "while", "switch", "catch"]
# The line patterns.
PY_CLASS = r"(?Us)^class\s+(\w+)\s*(?:\((.*?)\))?\s*:"
PY_DEF = r"(?Us)^(async\s+)?def\s+(\w+)\s*\((.*?)\)\s*(?:->\s*(.+?))?\s*:"
PY_DEF_START = r"(?Us)^(?:async\s+)?def\s+(\w+)"
PY_FROM = r"(?Us)^from\s+([\w.]+)\s+import\s+(.+)"
PY_IMPORT = r"(?Us)^import\s+([\w.]+)"
# (Calls begin where a word does and words are not given back, so a long word costs its length and not its square.)
PY_CALL = r"(?Us)(?<!\w)(\w++)\s*+\("
PY_GETATTR = r"""(?Us)getattr\s*\(\s*\w+\s*,\s*['"](\w+)['"]"""
JS_FUNCTIONS = [
    r"(?Us)(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\((.*?)\)",
    r"(?Us)(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\((.*?)\)\s*=>",
    r"(?Us)(?:export\s+)?(?:async\s+)?(\w+)\s*\((.*?)\)\s*\{",
]
JS_CLASS = r"(?Us)(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"
JS_IMPORT = r"""(?Us)import\s+.*?\s+from\s+['"](.+?)['"]"""
JS_CALL = r"(?Us)(?<!function\s)(?<!class\s)(\w++)\s*+\("
GO_FUNCTION = r"(?Us)func\s+(?:\((\w+)\s+\*?(\w+)\)\s+)?(\w+)\s*\((.*?)\)"
GO_STRUCT = r"(?Us)type\s+(\w+)\s+struct\s*\{"
GO_IMPORT = r'(?Us)"([\w/.-]+)"'
JAVA_CLASS = r"(?Us)(?:public|private|protected)?\s*(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?"
JAVA_METHOD = r"(?Us)(?:public|private|protected)\s+(?:static\s+)?(?:\w+(?:<.*?>)?)\s+(\w+)\s*\((.*?)\)"
JAVA_IMPORT = r"(?Us)import\s+([\w.]+);"
RUST_FUNCTION = r"(?Us)(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<.*?>)?\s*\((.*?)\)"
RUST_STRUCT = r"(?Us)(?:pub\s+)?struct\s+(\w+)"
RUST_USE = r"(?Us)use\s+([\w:]+)"
ANY_FUNCTIONS = [
    r"(?Us)(?:pub(?:lic)?|private|protected|static|async|export)?\s*(?:fun|func|fn|def|function|sub)\s+(\w+)\s*\(",
    r"(?Us)(?:pub(?:lic)?|private|protected|static)?\s+\w+\s+(\w+)\s*\(",
]
ANY_CLASS = r"(?Us)(?:pub(?:lic)?|private|export)?\s*(?:class|struct|interface|trait|contract|object)\s+(\w+)"
# Test files by name.
PY_TESTS = ["test_*.py", "*_test.py"]
JS_TESTS = ["*.test.*", "*.spec.*", "test_*.*"]

NODE_COLUMNS = ["id", "name", "type", "language", "file", "line", "end_line", "signature", "docstring", "sha256", "is_test", "parent_class", "body_preview"]
EDGE_COLUMNS = ["from_id", "to_id", "from_name", "to_name", "type", "file", "line", "part", "place"]


def lines_of(sources: DataFrame) -> DataFrame:
    """(file, language, sha256, line from 1, txt): a trailing empty line is a line."""
    split = sources.select("file", "language", "sha256", F.split("source", "\n", -1).alias("lines"))
    return split.select("file", "language", "sha256", F.posexplode("lines").alias("at", "txt")).select("file", "language", "sha256", (F.col("at") + 1).alias("line"), "txt")


def _line_structs(sources: DataFrame, rows: Callable[[Column], Column]) -> DataFrame:
    """As ``lines_of`` with more columns: ``rows`` gives a struct a line of the file's array of lines."""
    found = sources.select("file", "language", "sha256", F.posexplode(folds.bound(F.split("source", "\n", -1), rows)).alias("at", "x"))
    return found.select("file", "language", "sha256", (F.col("at") + 1).alias("line"), "x.*")


def nodes_from(rows: DataFrame, kind: str, name: Column, *, signature: Column | str = "", docstring: Column | str = "", is_test: Column | bool = False, parent: Column | str = "", preview: Column | str = "") -> DataFrame:
    """Nodes with the standing columns of the rows (file, language, sha256, line)."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return rows.select(
        X.node_id(F.col("file"), name, F.col("line")).alias("id"),
        name.alias("name"),
        F.lit(kind).alias("type"),
        "language",
        "file",
        "line",
        F.lit(0).alias("end_line"),
        as_column(signature).alias("signature"),
        as_column(docstring).alias("docstring"),
        "sha256",
        as_column(is_test).alias("is_test"),
        as_column(parent).alias("parent_class"),
        as_column(preview).alias("body_preview"),
    )


def edges_from(rows: DataFrame, kind: str, source: Column | str, target: Column, part: int, place: Column | int = 0) -> DataFrame:
    """Edges; ``part`` and ``place`` order a file's edges of one line as they are found."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return rows.select(
        F.lit("").alias("from_id"), F.lit("").alias("to_id"), as_column(source).alias("from_name"), target.alias("to_name"), F.lit(kind).alias("type"), "file", "line", F.lit(part).alias("part"), as_column(place).cast("int").alias("place")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_CONTEXT = "struct<class_name:string,class_indent:int,def_name:string,def_indent:int>"


def _python_facts(txt: Column, left: Column, at: Column) -> Column:
    """What a line says by itself."""
    is_class = left.rlike(PY_CLASS)
    return F.struct(
        (at + 1).alias("line"), txt.alias("txt"), left.alias("left"), (F.length(txt) - F.length(left)).alias("indent"),
        is_class.alias("is_class"), (~is_class & left.rlike(PY_DEF)).alias("is_def"), left.rlike(PY_DEF_START).alias("starts_def"), ((left != "") & ~left.startswith("#")).alias("solid"),
    )


def _python_step(now: Column, x: Column) -> Column:
    """A class stands until a definition at or left of its own indent, a function until a line (no blank, no comment) at or left of its own."""
    class_over = x["is_def"] & (x["indent"] <= now["class_indent"])
    def_over = x["solid"] & (x["indent"] <= now["def_indent"])
    return F.struct(
        F.when(x["is_class"], F.regexp_extract(x["left"], PY_CLASS, 1)).when(~class_over, now["class_name"]).alias("class_name"),
        F.when(x["is_class"], x["indent"]).otherwise(now["class_indent"]).alias("class_indent"),
        F.when(x["starts_def"], F.regexp_extract(x["left"], PY_DEF_START, 1)).when(~def_over, now["def_name"]).alias("def_name"),
        F.when(x["starts_def"], x["indent"]).otherwise(now["def_indent"]).alias("def_indent"),
    )


def _python_rows(lines: Column) -> Column:
    """The facts of a file's lines with their class (``parent``) and function (``inside``) context: one fold over the array."""
    lefts = F.transform(lines, X.strip_left)
    facts = F.transform(F.arrays_zip(lines.alias("txt"), lefts.alias("left")), lambda z, at: _python_facts(z["txt"], z["left"], at))
    none = F.struct(F.lit(None).alias("class_name"), F.lit(-1).alias("class_indent"), F.lit(None).alias("def_name"), F.lit(-1).alias("def_indent"))
    emit = lambda now, x: F.struct(F.coalesce(now["class_name"], F.lit("")).alias("parent"), F.when(~x["starts_def"], now["def_name"]).alias("inside"))
    with_context = lambda f: F.zip_with(f, folds.scan(f, none, _CONTEXT, _python_step, emit, "struct<parent:string,inside:string>"), lambda x, c: x.withField("parent", c["parent"]).withField("inside", c["inside"]))
    return folds.bound(facts, with_context)


def _docstring(ahead: Column) -> Column:
    """The docstring that begins on the next line, from the twenty lines ahead."""
    rest = F.slice(ahead, 2, 19)

    def of(head: Column) -> Column:
        whole = F.endswith(head, F.substring(head, 1, 3)) & (F.length(head) > 6)
        one = F.substr(head, F.lit(4), F.greatest(F.length(head) - 6, F.lit(0)))
        closing = folds.bound(F.substring(head, 1, 3), lambda quote: F.array_position(F.transform(rest, lambda x: F.contains(x, quote)), True))
        many = folds.bound(closing, lambda c: F.concat_ws(" ", F.substr(head, F.lit(4)), folds.bound(parts(c), lambda p: F.when(F.size(p) > 0, F.array_join(p, " ")))))
        return X.strip(F.when(head.rlike("^(\"\"\"|\'\'\')"), F.when(whole, one).otherwise(many)).otherwise(""))

    def parts(closing: Column) -> Column:
        taken = F.when(closing > 0, F.slice(rest, F.lit(1), F.greatest(closing, F.lit(1)).cast("int"))).otherwise(rest)
        return F.transform(taken, lambda x, k: F.when((closing > 0) & (k == closing - 1), F.regexp_replace(X.strip(x), "[\"']+$", "")).otherwise(X.strip(x)))

    return folds.bound(X.strip(F.coalesce(F.get(ahead, 0), F.lit(""))), of)


def _preview(ahead: Column) -> Column:
    """The next twenty lines without blanks and comments, in one line of 300 characters at most."""
    kept = F.filter(F.transform(ahead, X.strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.substring(F.array_join(kept, " "), 1, 300)


def _edge_struct(kind: str, line: Column, source: Column, target: Column, part: int, place: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), line.alias("line"), source.alias("from_name"), target.alias("to_name"), F.lit(part).alias("part"), place.cast("int").alias("place"))


def _python_edges(file: Column, x: Column) -> Column:
    """All edges that a line gives, as one array."""
    some = lambda given, listed: F.when(given, listed).otherwise(F.array())
    left, line, inside = x["left"], x["line"], x["inside"]
    name = F.regexp_extract(left, PY_CLASS, 1)
    bases = F.transform(F.split(F.coalesce(F.regexp_extract(left, PY_CLASS, 2), F.lit("")), ","), X.strip)
    inherits = F.filter(F.transform(bases, lambda b, k: _edge_struct("inherits", line, name, b, 0, k)), lambda e: (e["to_name"] != "") & ~e["to_name"].isin(PLAIN_BASES))
    member = F.array(_edge_struct("member_of", line, F.regexp_extract(left, PY_DEF, 2), x["parent"], 0, F.lit(0)))
    module, both = X.module_name(file), X.strip(x["txt"])
    imported = F.transform(F.split(F.regexp_extract(both, PY_FROM, 2), ","), lambda n: X.strip(F.substring_index(X.strip(n), " as ", 1)))
    from_module = F.regexp_extract(both, PY_FROM, 1)
    froms = F.transform(imported, lambda n, k: _edge_struct("imports", line, module, F.when(n != "", F.concat(from_module, F.lit("."), n)).otherwise(""), 1, k))
    plain = F.array(_edge_struct("imports", line, module, F.regexp_extract(both, PY_IMPORT, 1), 1, F.lit(0)))
    # Calls: what the line's function calls, in the order of the line, then its getattr names.
    called = F.transform(F.regexp_extract_all(left, F.lit(PY_CALL), 1), lambda c, k: _edge_struct("calls", line, inside, c, 2, k))
    called = F.filter(called, lambda e: ((e["to_name"] != inside) & ~e["to_name"].startswith("_")) | e["to_name"].startswith("__"))
    dynamic = F.transform(F.regexp_extract_all(left, F.lit(PY_GETATTR), 1), lambda c, k: _edge_struct("calls", line, inside, c, 2, k + 100_000))
    calls = F.filter(F.concat(called, dynamic), lambda e: ~e["to_name"].isin(CALL_DENYLIST))
    return F.concat(
        some(x["is_class"], inherits), some(x["is_def"] & (x["parent"] != ""), member), some(both.rlike(PY_FROM), F.filter(froms, lambda e: e["to_name"] != "")), some(both.rlike(PY_IMPORT), plain), some(inside.isNotNull(), calls)
    )


def _test_edges(edges: Column, rows: Column) -> Column:
    """In a test file, for each test an edge for each call of its name; calls are sorted by name, so a test's are one slice."""
    calls = F.array_sort(F.transform(F.filter(edges, lambda e: e["type"] == "calls"), lambda e: F.struct(e["from_name"].alias("from_name"), e["line"].alias("line"), e["place"].alias("place"), e["to_name"].alias("to_name"))))
    tests = F.filter(rows, lambda x: (x["is_class"] | x["is_def"]) & _is_test(x, F.lit(True)))

    def of(s: Column) -> Column:
        def one(t: Column) -> Column:
            first = F.array_position(s["names"], _python_name(t))
            count = F.size(s["names"]) - F.array_position(s["back"], _python_name(t)) + 2 - first
            mine = F.slice(s["calls"], F.greatest(first, F.lit(1)).cast("int"), F.when(first > 0, count).otherwise(0).cast("int"))
            return F.transform(mine, lambda c: _edge_struct("tests", t["line"], c["from_name"], c["to_name"], 3, c["line"] * 1000 + c["place"] % 1000))

        return F.flatten(F.transform(tests, one))

    names = lambda c: F.transform(c, lambda e: e["from_name"])
    return folds.bound(calls, lambda c: folds.bound(F.struct(c.alias("calls"), names(c).alias("names"), F.reverse(names(c)).alias("back")), of))


def parse_python(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a file come from one fold over its lines each, inside the file's row: nothing is shuffled."""
    python = sources.where("language = 'python'")
    test_file = X.matches_any(X.basename(F.col("file")), PY_TESTS)
    lines = F.split("source", "\n", -1)

    def defined(lines: Column) -> Column:
        """The lines that define something, with the twenty lines after each."""
        found = F.filter(_python_rows(lines), lambda x: x["is_class"] | x["is_def"])
        return F.transform(found, lambda x: x.withField("ahead", F.slice(lines, x["line"] + 1, F.lit(20))))

    def edges_of(rows: Column) -> Column:
        every = F.flatten(F.transform(rows, lambda x: _python_edges(F.col("file"), x)))
        return folds.bound(every, lambda e: F.concat(e, F.when(test_file, _test_edges(e, rows)).otherwise(F.array())))

    nodes = _python_nodes(python.select("file", "language", "sha256", F.explode(folds.bound(lines, defined)).alias("x")).select("file", "language", "sha256", "x.*"))
    found = python.select("file", F.explode(folds.bound(folds.bound(lines, _python_rows), edges_of)).alias("e"))
    return nodes, found.select(F.lit("").alias("from_id"), F.lit("").alias("to_id"), "e.from_name", "e.to_name", "e.type", "file", "e.line", "e.part", "e.place")


def _python_name(x: Column) -> Column:
    return F.when(x["is_class"], F.regexp_extract(x["left"], PY_CLASS, 1)).otherwise(F.regexp_extract(x["left"], PY_DEF, 2))


def _is_test(x: Column, test_file: Column) -> Column:
    name = _python_name(x)
    return F.when(x["is_class"], name.startswith("Test") & test_file).otherwise(name.startswith("test_") | (test_file & name.startswith("test")))


def _python_nodes(rows: DataFrame) -> DataFrame:
    x = F.struct("is_class", "left")
    bases = F.coalesce(F.regexp_extract("left", PY_CLASS, 2), F.lit(""))
    given, back = F.regexp_extract("left", PY_DEF, 3), F.coalesce(F.regexp_extract("left", PY_DEF, 4), F.lit(""))
    word = F.when(F.regexp_extract("left", PY_DEF, 1) != "", "async def").otherwise("def")
    is_class, name = F.col("is_class"), F.col("name")
    named = rows.withColumns({"name": _python_name(x), "is_test": _is_test(x, X.matches_any(X.basename(F.col("file")), PY_TESTS))})
    of_class = F.concat(F.lit("class "), name, F.when(bases != "", F.concat(F.lit("("), bases, F.lit(")"))).otherwise(""))
    of_def = F.concat(word, F.lit(" "), name, F.lit("("), given, F.lit(")"), F.when(back != "", F.concat(F.lit(" -> "), back)).otherwise(""))
    made = nodes_from(named, "class", name, signature=F.when(is_class, of_class).otherwise(of_def), docstring=_docstring(F.col("ahead")), is_test=F.col("is_test"), parent=F.when(is_class, "").otherwise(F.col("parent")), preview=F.when(is_class, "").otherwise(_preview(F.col("ahead"))))
    return made.withColumn("type", F.when(F.col("signature").startswith("class "), "class").otherwise("function"))


def _first_match(patterns: list[str], group: int, line: Column) -> Column:
    """The group in the first pattern that the line fits, or null."""
    out = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        out = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group)).otherwise(out)
    return out


def _other(pattern: str) -> Column:
    """Whether a line's ``name`` is not that of the pattern too: one name on one line is one node, the pattern's."""
    return F.col("name") != F.regexp_extract("txt", pattern, 1)


def _extends(name: Column, base: Column) -> Column:
    return F.concat(F.lit("class "), name, F.when(F.coalesce(base, F.lit("")) != "", F.concat(F.lit(" extends "), base)).otherwise(""))


def parse_script(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JavaScript, TypeScript and TSX. Calls are kept to names that the file defines and have no caller."""
    scripts = sources.where(F.col("language").isin("javascript", "typescript", "tsx"))
    rows = lines_of(scripts)
    line = F.col("txt")
    found = rows.withColumns({"name": _first_match(JS_FUNCTIONS, 1, line), "given": _first_match(JS_FUNCTIONS, 2, line)}).where(F.col("name").isNotNull() & ~F.col("name").isin(SCRIPT_KEYWORDS) & _other(JS_CLASS))
    functions = nodes_from(found, "function", F.col("name"), signature=F.concat(F.lit("function "), F.col("name"), F.lit("("), F.col("given"), F.lit(")")), is_test=X.matches_any(X.basename(F.col("file")), JS_TESTS))
    classes = rows.where(line.rlike(JS_CLASS)).withColumns({"name": F.regexp_extract(line, JS_CLASS, 1), "base": F.coalesce(F.regexp_extract(line, JS_CLASS, 2), F.lit(""))})
    class_nodes = nodes_from(classes, "class", F.col("name"), signature=_extends(F.col("name"), F.col("base")))
    nodes = functions.unionByName(class_nodes)

    def calls_of(lines: Column) -> Column:
        """The file's calls of names that it defines, from its own array of lines."""

        def names(x: Column) -> Column:
            name, of_class = _first_match(JS_FUNCTIONS, 1, x), F.when(x.rlike(JS_CLASS), F.regexp_extract(x, JS_CLASS, 1))
            return F.array(F.when(~name.isin(SCRIPT_KEYWORDS), name), of_class)

        every = F.transform(lines, lambda x, at: F.transform(F.regexp_extract_all(x, F.lit(JS_CALL), 1), lambda c, k: F.struct((at + 1).alias("line"), k.alias("place"), c.alias("called"))))
        own = F.array_distinct(F.array_compact(F.flatten(F.transform(lines, names))))
        return folds.bound(own, lambda known: F.filter(F.flatten(every), lambda c: F.array_contains(known, c["called"])))

    calls = scripts.select("file", F.explode(folds.bound(F.split("source", "\n", -1), calls_of)).alias("c")).select("file", "c.*")
    edges = _union([
        edges_from(classes.where("base <> ''"), "inherits", F.col("name"), F.col("base"), 0),
        edges_from(rows.where(line.rlike(JS_IMPORT)), "imports", F.col("file"), F.regexp_extract(line, JS_IMPORT, 1), 0, 1),
        edges_from(calls, "calls", "", F.col("called"), 2, F.col("place")),
    ])
    return nodes, edges


def parse_go(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    go = sources.where("language = 'go'")
    # A quoted path is an import if the word stands before the first place of the line's text.
    split = F.split("source", "\n", -1)
    first = F.transform(split, lambda x: F.struct(x.alias("txt"), F.when(x.rlike(GO_IMPORT), F.instr(F.col("source"), x)).alias("first")))
    rows = go.select("file", "language", "sha256", F.instr("source", "import").alias("word"), F.posexplode(first).alias("at", "x")).select("file", "language", "sha256", "word", (F.col("at") + 1).alias("line"), "x.txt", "x.first")
    line = F.col("txt")
    functions = rows.where(line.rlike(GO_FUNCTION)).withColumns({k: F.coalesce(F.regexp_extract(line, GO_FUNCTION, g), F.lit("")) for k, g in (("self", 1), ("owner", 2), ("name", 3), ("given", 4))})
    call = F.concat(F.col("name"), F.lit("("), F.col("given"), F.lit(")"))
    signature = F.when(F.col("owner") != "", F.concat(F.lit("func ("), F.col("self"), F.lit(" "), F.col("owner"), F.lit(") "), call)).otherwise(F.concat(F.lit("func "), call))
    structs = rows.where(line.rlike(GO_STRUCT)).withColumn("name", F.regexp_extract(line, GO_STRUCT, 1))
    nodes = nodes_from(functions, "function", F.col("name"), signature=signature, is_test=F.col("name").startswith("Test") & F.col("file").endswith("_test.go"), parent=F.col("owner")).unionByName(
        nodes_from(structs, "class", F.col("name"), signature=F.concat(F.lit("type "), F.col("name"), F.lit(" struct")))
    )
    imports = rows.where(line.rlike(GO_IMPORT) & (F.col("word") > 0) & (F.col("word") + 6 <= F.col("first")))
    edges = _union([edges_from(functions.where("owner <> ''"), "member_of", F.col("name"), F.col("owner"), 0), edges_from(imports, "imports", F.col("file"), F.regexp_extract(line, GO_IMPORT, 1), 0, 1)])
    return nodes, edges


def parse_java(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _line_structs(sources.where("language = 'java'"), lambda lines: F.transform(lines, lambda x, at: F.struct(x.alias("txt"), F.coalesce(F.get(lines, at - 1), F.lit("")).alias("above"))))
    line = F.col("txt")
    classes = rows.where(line.rlike(JAVA_CLASS)).withColumns({"name": F.regexp_extract(line, JAVA_CLASS, 1), "base": F.coalesce(F.regexp_extract(line, JAVA_CLASS, 2), F.lit(""))})
    methods = rows.where(line.rlike(JAVA_METHOD)).withColumns({"name": F.regexp_extract(line, JAVA_METHOD, 1), "given": F.regexp_extract(line, JAVA_METHOD, 2)}).where(~F.col("name").isin(METHOD_KEYWORDS))
    nodes = nodes_from(classes.where(_other(JAVA_METHOD)), "class", F.col("name"), signature=_extends(F.col("name"), F.col("base")), is_test=X.basename(F.col("file")).contains("Test")).unionByName(
        nodes_from(methods, "function", F.col("name"), signature=F.concat(F.col("name"), F.lit("("), F.col("given"), F.lit(")")), is_test=F.col("above").contains("@Test"))
    )
    edges = _union([
        edges_from(classes.where("base <> ''"), "inherits", F.col("name"), F.col("base"), 0),
        edges_from(rows.where(line.rlike(JAVA_IMPORT)), "imports", F.col("file"), F.regexp_extract(line, JAVA_IMPORT, 1), 0, 1),
    ])
    return nodes, edges


def parse_rust(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A test attribute holds until the next function; a tests module until the end of the file."""
    line = F.col("txt")

    def flags(x: Column) -> Column:
        both = X.strip(x)
        attribute = both == "#[test]"
        return F.struct(x.alias("txt"), both.alias("both"), attribute.alias("attribute"), (x.rlike(RUST_FUNCTION) & ~attribute).alias("is_fn"), both.contains("mod tests").alias("tests"))

    def step(now: Column, x: Column) -> Column:
        marked = (now["marked"] & ~now["ended"]) | x["attribute"]
        return F.struct(marked.alias("marked"), x["is_fn"].alias("ended"), (now["inside"] | x["tests"]).alias("inside"))

    def tested(lines: Column) -> Column:
        start = F.struct(F.lit(False).alias("marked"), F.lit(False).alias("ended"), F.lit(False).alias("inside"))
        seen = lambda f: folds.scan(f, start, "struct<marked:boolean,ended:boolean,inside:boolean>", step, lambda now, _: now["marked"] | now["inside"], "boolean")
        return folds.bound(F.transform(lines, flags), lambda f: F.zip_with(f, seen(f), lambda x, t: x.withField("is_test", t)))

    rows = _line_structs(sources.where("language = 'rust'"), tested)
    functions = rows.where("is_fn").withColumns({"name": F.regexp_extract(line, RUST_FUNCTION, 1), "given": F.regexp_extract(line, RUST_FUNCTION, 2)})
    structs = rows.where(line.rlike(RUST_STRUCT)).withColumn("name", F.regexp_extract(line, RUST_STRUCT, 1))
    nodes = nodes_from(functions, "function", F.col("name"), signature=F.concat(F.lit("fn "), F.col("name"), F.lit("("), F.col("given"), F.lit(")")), is_test=F.col("is_test")).unionByName(
        nodes_from(structs, "class", F.col("name"), signature=F.concat(F.lit("struct "), F.col("name")))
    )
    edges = edges_from(rows.where(F.col("both").rlike(RUST_USE)), "imports", F.col("file"), F.regexp_extract("both", RUST_USE, 1), 0, 1)
    return nodes, edges


def parse_generic(sources: DataFrame) -> DataFrame:
    """The other languages: nodes alone, without signatures."""
    rows = lines_of(sources.where(~F.col("language").isin(*OWN_PARSER)))
    line = F.col("txt")
    found = rows.withColumn("name", _first_match(ANY_FUNCTIONS, 1, line)).where(F.col("name").isNotNull() & ~F.col("name").isin(SCRIPT_KEYWORDS) & _other(ANY_CLASS))
    classes = rows.where(line.rlike(ANY_CLASS)).withColumn("name", F.regexp_extract(line, ANY_CLASS, 1))
    return nodes_from(found, "function", F.col("name")).unionByName(nodes_from(classes, "class", F.col("name")))


_PARSERS = {("python",): parse_python, ("javascript", "typescript", "tsx"): parse_script, ("go",): parse_go, ("java",): parse_java, ("rust",): parse_rust}


def parse(sources: DataFrame, languages: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and unresolved edges of all files. Edges hold their order (file, part, line, place) in place of an id.

    Each parser scans the sources; ``languages``, where they are known, leaves
    out the parsers that have nothing to do.
    """
    used = [p for of, p in _PARSERS.items() if languages is None or languages & set(of)]
    parsed = [p(sources) for p in used or [parse_python]]
    nodes, edges = [p[0] for p in parsed], [p[1] for p in parsed]
    if languages is None or languages - set(OWN_PARSER):
        nodes.append(parse_generic(sources))
    return _union(nodes).select(NODE_COLUMNS), _union(edges).select(EDGE_COLUMNS)


def names_of(nodes: DataFrame) -> DataFrame:
    """(name, id): the dictionary that call edges point to by name."""
    return nodes.select("name", "id")


def expand(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Call edges fan out to every node of the called name and get its id; all others stay as they are.

    Edges are stored as they were found, and the dictionary beside them: a name
    that n calls have and m nodes is n + m rows, and a change of a file touches
    its own. The n times m pairs exist only where a reader asks for them, in a
    plain left join on the name that adaptive execution splits for a hot one.
    """
    targets = names.select(F.col("name").alias("_name"), F.col("id").alias("_id"))
    joined = edges.join(targets, (F.col("type") == "calls") & (F.col("to_name") == F.col("_name")), "left")
    return joined.withColumn("to_id", F.coalesce("_id", "to_id")).select(*edges.columns)


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``expand`` by the dictionary of these nodes."""
    return expand(edges, names_of(nodes))


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with an ``id`` that repeats from run to run: a hash of their place and target, not a global count."""
    return edges.withColumn("id", F.xxhash64("file", "part", "line", "place", "type", "from_name", "to_name", "to_id"))
