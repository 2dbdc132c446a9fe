"""Source files made of the star schema's rows, and the graph rows that extraction must find in them.

A file's path and lines, and the rows expected of it, are SQL expressions over a
customer's key ``k`` that Spark and DuckDB read alike. The expected rows are
written down by hand from the line rules; nothing here parses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import languages
from codestrata.plans import binding
from codestrata.sources import shared, trees


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    line: int
    signature: str = "''"
    docstring: str = "''"
    is_test: str = "FALSE"
    parent: str = "''"
    preview: str = "''"


@dataclass(frozen=True)
class Edge:
    kind: str
    source: str
    target: str
    line: int


@dataclass(frozen=True)
class Fixture:
    path: str
    language: str
    lines: list[str]
    nodes: list[Node]
    edges: list[Edge] = field(default_factory=list)


def _after(start: str) -> str:
    """A preview of the test file: what stands at its end follows ``start``, cut at 300 characters."""
    return f"substr(concat({start}, '\"\"\"Long. \"\"\" x = \"', repeat('a', 200), '\" y = \"', repeat('b', 200), '\"'), 1, 300)"


PYTHON = Fixture(
    path="concat('pkg/m', k, '.py')",
    language="'python'",
    lines=[
        "concat('from shop.core import base', k % 7, ' as b, tool')",
        "'import os, sys'",
        "concat('class Box', k, '(Base', k % 3, ', ABC):')",
        "'    \"\"\"Holds'",
        "'    things.\"\"\"'",
        "'    # a note'",
        "''",
        "concat('    async def run', k, '(self, a):')",
        "'        \"\"\"Runs it.\"\"\"'",
        "concat('        value = getattr(self, \"load', k % 5, '\")')",
        "concat('        return self.make', k % 4, '(value)')",
        "''",
        "concat('def _helper', k, '(x) -> int:')",
        "concat('    return run', k, '(x)')",
        "''",
        "concat('def test_all', k, '():')",
        "concat('    _helper', k, '(1)')",
        "concat('    Box', k, '()')",
    ],
    nodes=[
        Node("concat('Box', k)", "class", 3, "concat('class Box', k, '(Base', k % 3, ', ABC)')", "'Holds things.'"),
        Node(
            "concat('run', k)", "function", 8, "concat('async def run', k, '(self, a)')", "'Runs it.'", parent="concat('Box', k)",
            preview="concat('\"\"\"Runs it.\"\"\" value = getattr(self, \"load', k % 5, '\") return self.make', k % 4, '(value) def _helper', k, '(x) -> int: return run', k, '(x) def test_all', k, '(): _helper', k, '(1) Box', k, '()')",
        ),
        Node("concat('_helper', k)", "function", 13, "concat('def _helper', k, '(x) -> int')", preview="concat('return run', k, '(x) def test_all', k, '(): _helper', k, '(1) Box', k, '()')"),
        Node("concat('test_all', k)", "function", 16, "concat('def test_all', k, '()')", is_test="TRUE", preview="concat('_helper', k, '(1) Box', k, '()')"),
    ],
    edges=[
        Edge("imports", "concat('pkg.m', k)", "concat('shop.core.base', k % 7)", 1),
        Edge("imports", "concat('pkg.m', k)", "'shop.core.tool'", 1),
        Edge("imports", "concat('pkg.m', k)", "'os'", 2),
        Edge("inherits", "concat('Box', k)", "concat('Base', k % 3)", 3),
        Edge("member_of", "concat('run', k)", "concat('Box', k)", 8),
        Edge("calls", "concat('run', k)", "concat('load', k % 5)", 10),
        Edge("calls", "concat('run', k)", "concat('make', k % 4)", 11),
        Edge("calls", "concat('_helper', k)", "concat('run', k)", 14),
        Edge("calls", "concat('test_all', k)", "concat('Box', k)", 18),
    ],
)

#: A test file: a test class, tests by their names, an edge for each call of each test; a body beyond the cut of a preview.
PYTEST = Fixture(
    path="concat('tests/test_m', k, '.py')",
    language="'python'",
    lines=[
        "concat('from shop.m', k, ' import run', k)",
        "''",
        "concat('class TestRun', k, ':')",
        "concat('    def test_one', k, '(self):')",
        "concat('        run', k, '(1)')",
        "concat('        make', k % 4, '(run', k, '(2))')",
        "concat('    def helper', k, '(self):')",
        "concat('        deep', k, '()')",
        "''",
        "concat('def test_two', k, '():')",
        "concat('    load', k % 5, '()')",
        "''",
        "concat('def testing', k, '():')",
        "'    \"\"\"Long.'",
        "'    \"\"\"'",
        "'    # a note'",
        "concat('    x = \"', repeat('a', 200), '\"')",
        "concat('    y = \"', repeat('b', 200), '\"')",
    ],
    nodes=[
        Node("concat('TestRun', k)", "class", 3, "concat('class TestRun', k)", is_test="TRUE"),
        Node("concat('test_one', k)", "function", 4, "concat('def test_one', k, '(self)')", is_test="TRUE", parent="concat('TestRun', k)", preview=_after("concat('run', k, '(1) make', k % 4, '(run', k, '(2)) def helper', k, '(self): deep', k, '() def test_two', k, '(): load', k % 5, '() def testing', k, '(): ')")),
        Node("concat('helper', k)", "function", 7, "concat('def helper', k, '(self)')", parent="concat('TestRun', k)", preview=_after("concat('deep', k, '() def test_two', k, '(): load', k % 5, '() def testing', k, '(): ')")),
        Node("concat('test_two', k)", "function", 10, "concat('def test_two', k, '()')", is_test="TRUE", preview=_after("concat('load', k % 5, '() def testing', k, '(): ')")),
        Node("concat('testing', k)", "function", 13, "concat('def testing', k, '()')", "'Long.'", is_test="TRUE", preview=_after("''")),
    ],
    edges=[
        Edge("imports", "concat('tests.test_m', k)", "concat('shop.m', k, '.run', k)", 1),
        Edge("member_of", "concat('test_one', k)", "concat('TestRun', k)", 4),
        Edge("member_of", "concat('helper', k)", "concat('TestRun', k)", 7),
        Edge("calls", "concat('test_one', k)", "concat('run', k)", 5),
        Edge("calls", "concat('test_one', k)", "concat('make', k % 4)", 6),
        Edge("calls", "concat('test_one', k)", "concat('run', k)", 6),
        Edge("calls", "concat('helper', k)", "concat('deep', k)", 8),
        Edge("calls", "concat('test_two', k)", "concat('load', k % 5)", 11),
        Edge("tests", "concat('test_one', k)", "concat('run', k)", 4),
        Edge("tests", "concat('test_one', k)", "concat('make', k % 4)", 4),
        Edge("tests", "concat('test_one', k)", "concat('run', k)", 4),
        Edge("tests", "concat('test_two', k)", "concat('load', k % 5)", 10),
    ],
)

SCRIPT = Fixture(
    path="concat('web/c', k, CASE k % 5 WHEN 0 THEN '.spec.js' WHEN 1 THEN '.tsx' ELSE '.ts' END)",
    language="CASE k % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN 'tsx' ELSE 'typescript' END",
    lines=[
        "concat('import { x } from \"./lib', k % 3, '\"')",
        "concat('export class View', k, ' extends Base', k % 4, ' {')",
        "concat('  async draw', k, '(a, b) {')",
        "concat('    load', k, '(a);')",
        "'  }'",
        "'}'",
        "concat('export const load', k, ' = async (p) => {')",
        "concat('export function save', k, '(q) {')",
        "concat('  if (q) { draw', k, '(q); }')",
        "'}'",
    ],
    nodes=[
        Node("concat('View', k)", "class", 2, "concat('class View', k, ' extends Base', k % 4)"),
        Node("concat('draw', k)", "function", 3, "concat('function draw', k, '(a, b)')", is_test="k % 5 = 0"),
        Node("concat('load', k)", "function", 7, "concat('function load', k, '(p)')", is_test="k % 5 = 0"),
        Node("concat('save', k)", "function", 8, "concat('function save', k, '(q)')", is_test="k % 5 = 0"),
    ],
    edges=[
        Edge("imports", "file", "concat('./lib', k % 3)", 1),
        Edge("inherits", "concat('View', k)", "concat('Base', k % 4)", 2),
        Edge("calls", "''", "concat('draw', k)", 3),
        Edge("calls", "''", "concat('load', k)", 4),
        Edge("calls", "''", "concat('draw', k)", 9),
    ],
)

GO = Fixture(
    path="concat('svc/h', k, CASE k % 5 WHEN 0 THEN '_test.go' ELSE '.go' END)",
    language="'go'",
    lines=[
        "'package svc'",
        "'import ('",
        "'    \"fmt\"'",
        "concat('    \"net/http', k % 3, '\"')",
        "')'",
        "concat('type Store', k, ' struct {')",
        "'}'",
        "concat('func (s *Store', k, ') Get', k, '(id int) string {')",
        "'}'",
        "concat('func Test', k, '(t T) {')",
        "'}'",
    ],
    nodes=[
        Node("concat('Store', k)", "class", 6, "concat('type Store', k, ' struct')"),
        Node("concat('Get', k)", "function", 8, "concat('func (s Store', k, ') Get', k, '(id int)')", parent="concat('Store', k)"),
        Node("concat('Test', k)", "function", 10, "concat('func Test', k, '(t T)')", is_test="k % 5 = 0"),
    ],
    edges=[Edge("imports", "file", "'fmt'", 3), Edge("imports", "file", "concat('net/http', k % 3)", 4), Edge("member_of", "concat('Get', k)", "concat('Store', k)", 8)],
)

JAVA = Fixture(
    path="concat('app/A', k, CASE k % 5 WHEN 0 THEN 'Test' ELSE '' END, '.java')",
    language="'java'",
    lines=[
        "concat('import java.util.List', k % 3, ';')",
        "concat('public class A', k, ' extends B', k % 4, ' {')",
        "'    @Test'",
        "concat('    public void run', k, '(int a) {')",
        "concat('    private static List<String> calc', k, '(List<String> x) {')",
        "'        if (a) {'",
        "'}'",
    ],
    nodes=[
        Node("concat('A', k)", "class", 2, "concat('class A', k, ' extends B', k % 4)", is_test="k % 5 = 0"),
        Node("concat('run', k)", "function", 4, "concat('run', k, '(int a)')", is_test="TRUE"),
        Node("concat('calc', k)", "function", 5, "concat('calc', k, '(List<String> x)')"),
    ],
    edges=[Edge("imports", "file", "concat('java.util.List', k % 3)", 1), Edge("inherits", "concat('A', k)", "concat('B', k % 4)", 2)],
)

RUST = Fixture(
    path="concat('src/r', k, '.rs')",
    language="'rust'",
    lines=[
        "concat('use std::io', k % 3, ';')",
        "concat('pub struct R', k, ' {')",
        "'}'",
        "concat('pub fn open', k, '(a: u8) -> u8 {')",
        "'#[test]'",
        "concat('fn checks', k, '() {')",
        "concat('async fn after', k, '<T>(x: T) {')",
        "'mod tests {'",
        "concat('    fn inner', k, '() {')",
    ],
    nodes=[
        Node("concat('R', k)", "class", 2, "concat('struct R', k)"),
        Node("concat('open', k)", "function", 4, "concat('fn open', k, '(a: u8)')"),
        Node("concat('checks', k)", "function", 6, "concat('fn checks', k, '()')", is_test="TRUE"),
        Node("concat('after', k)", "function", 7, "concat('fn after', k, '(x: T)')"),
        Node("concat('inner', k)", "function", 9, "concat('fn inner', k, '()')", is_test="TRUE"),
    ],
    edges=[Edge("imports", "file", "concat('std::io', k % 3)", 1)],
)

GENERIC = Fixture(
    path="concat('any/x', k, CASE k % 3 WHEN 0 THEN '.kt' WHEN 1 THEN '.swift' ELSE '.rb' END)",
    language="CASE k % 3 WHEN 0 THEN 'kotlin' WHEN 1 THEN 'swift' ELSE 'ruby' END",
    lines=[
        "concat(CASE k % 3 WHEN 0 THEN 'data class Foo' WHEN 1 THEN 'public struct Foo' ELSE 'class Foo' END, k, CASE k % 3 WHEN 0 THEN '(val x: Int)' WHEN 1 THEN ' {' ELSE '' END)",
        "concat('  ', CASE k % 3 WHEN 0 THEN 'fun' WHEN 1 THEN 'func' ELSE 'def' END, ' bar', k, '(x)')",
        "'    if (x) then'",
        "concat('    call', k, '(x)')",
    ],
    nodes=[Node("concat('Foo', k)", "class", 1), Node("concat('bar', k)", "function", 2)],
)

FIXTURES = {"python": PYTHON, "pytest": PYTEST, "script": SCRIPT, "go": GO, "java": JAVA, "rust": RUST, "generic": GENERIC}


def sources(spark: SparkSession, sf_dir: str, fixture: Fixture) -> DataFrame:
    """(file, language, source, sha256): a file for each customer."""
    keyed = binding.dealt(binding.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
    made = keyed.select(F.expr(fixture.path).alias("file"), F.concat_ws("\n", *(F.expr(x) for x in fixture.lines)).alias("source"))
    return trees.with_hash(made).withColumn("language", languages.language_of(F.col("file"))).select("file", "language", "source", "sha256")


def _files(fixture: Fixture) -> str:
    source = " || chr(10) || ".join(f"({x})" for x in fixture.lines)
    return f"WITH files AS (SELECT k, {fixture.path} AS file, {fixture.language} AS language, substr(sha256({source}), 1, 16) AS sha256 FROM (SELECT c_custkey AS k FROM customer))"


def nodes_sql(fixture: Fixture) -> str:
    rows = " UNION ALL ".join(
        f"SELECT file, language, sha256, {n.name} AS name, '{n.kind}' AS type, {n.line} AS line, {n.signature} AS signature, {n.docstring} AS docstring, {n.is_test} AS is_test, {n.parent} AS parent_class, substr({n.preview}, 1, 300) AS body_preview FROM files"
        for n in fixture.nodes
    )
    return f"{_files(fixture)} SELECT substr(md5(file || '::' || name || '::' || line), 1, 12) AS id, * FROM ({rows})"


def edges_sql(fixture: Fixture) -> str:
    rows = [f"SELECT file, '{e.kind}' AS type, {e.source} AS from_name, {e.target} AS to_name, {e.line} AS line FROM files" for e in fixture.edges]
    return f"{_files(fixture)} {' UNION ALL '.join(rows)}"


# --- a tree of files ------------------------------------------------------------------------------

#: Path and text of a customer's files: to parse, in folders that are not entered, generated, of no known language, with other line ends and bad bytes.
TREE = [
    ("concat('pkg/d', k % 7, '/m', k, '.py')", "concat('def f', k, '():\n    pass\n')", "'python'"),
    ("concat('web/c', k, '.TSX')", "concat('// ünï ', k, '\n')", "'tsx'"),
    ("concat('web/node_modules/x', k, '.js')", "'x'", None),
    ("concat('.git/x', k, '.py')", "'x'", None),
    ("concat('gen/m', k, '_pb2.py')", "'x'", None),
    ("concat('gen/m', k, '.go')", "concat('// Code generated by tool ', k)", None),
    ("concat('doc/m', k, '.unknown')", "'x'", None),
]
BAD_BYTES = ("concat('raw/b', k, '.rb')", "concat('a', k)", "concat('a', k, '\nb\nc\n')", "'ruby'")
_TAIL = b"\r\nb\xff\rc\n"
#: Customers whose files, eight each, stand at one time (about): a file system of 250 GB often holds 16 million files.
TREE_CUSTOMERS = 1_000_000


def _each(files: DataFrame, root: str, act: Callable[[pafs.FileSystem, str, pa.RecordBatch], None]) -> None:
    """``act`` on every batch of files, on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            act(system, base, batch)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _write(system: pafs.FileSystem, base: str, batch: pa.RecordBatch) -> None:
    made = set()
    for file, content in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
        folder = f"{base}/{file}".rpartition("/")[0]
        if folder not in made:
            system.create_dir(folder, recursive=True)
            made.add(folder)
        with system.open_output_stream(f"{base}/{file}", compression=None) as out:
            out.write(content)


def _remove(system: pafs.FileSystem, base: str, batch: pa.RecordBatch) -> None:
    for file in batch.column(0).to_pylist():
        with suppress(FileNotFoundError):  # a task that is tried again
            system.delete_file(f"{base}/{file}")


def over_trees(spark: SparkSession, sf_dir: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in trees of all customers' files, as a written table.

    A tree has the files of about ``TREE_CUSTOMERS`` customers in a folder of its own; executors
    write it and, when it has been read, remove it before the next. So the files that stand at one
    time, of which a file system holds only so many, do not grow with the table. The last tree
    stays: where many files have just been removed, ext4 makes new ones several times slower.
    """
    customers = binding.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    number = max(1, -(-customers.count() // TREE_CUSTOMERS))
    each = [F.struct(F.expr(path).alias("file"), F.encode(F.expr(text.replace("\n", "\\n")), "UTF-8").alias("content")) for path, text, _ in TREE]
    each.append(F.struct(F.expr(BAD_BYTES[0]).alias("file"), F.concat(F.encode(F.expr(BAD_BYTES[1]), "UTF-8"), F.lit(_TAIL)).alias("content")))
    folder = shared.new_folder(spark, "trees")
    for part in range(number):
        keyed = binding.dealt(customers.where(F.pmod(F.xxhash64("k"), F.lit(number)) == part), "k")
        files = keyed.select(F.explode(F.array(*each)).alias("x")).select("x.file", "x.content")
        root = f"{folder}/tree-{part}"
        system, base = pafs.FileSystem.from_uri(root)
        system.create_dir(base, recursive=True)
        _each(files, root, _write)
        found = read(root)
        found.write.mode("append").parquet(f"{folder}/found")
        if part < number - 1:
            _each(files.select("file"), root, _remove)
            system.delete_dir(base)  # folders are left
    return spark.read.schema(found.schema).parquet(f"{folder}/found")


def tree_sql(raw: bool) -> str:
    """The sources of the tree with the hashes of their decoded texts; ``raw``: all watched files with the hashes of their bytes."""
    sha = lambda x: f"substr(sha256({x}), 1, 16)"
    line_feed = lambda x: x.replace("\n", "' || chr(10) || '")
    kept = [(path, line_feed(text), language) for path, text, language in TREE if language or raw and not any(x in path for x in ("node_modules", ".git", ".unknown"))]
    rows = [f"SELECT {path} AS file, {language or "''"} AS language, {sha(text)} AS sha256 FROM keyed" for path, text, language in kept]
    tail = "".join(f"\\x{b:02X}" for b in _TAIL)
    own = f"CAST({BAD_BYTES[1]} AS BLOB) || '{tail}'::BLOB" if raw else line_feed(BAD_BYTES[2])
    rows.append(f"SELECT {BAD_BYTES[0]}, {BAD_BYTES[3]}, {sha(own)} FROM keyed")
    columns = "file, sha256" if raw else "file, language, sha256"
    return f"WITH keyed AS (SELECT c_custkey AS k FROM customer) SELECT {columns} FROM ({' UNION ALL '.join(rows)})"
