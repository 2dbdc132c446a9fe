"""Source trees as tables: one row a file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.languages import language_of, supported_extensions
from codestrata.functions.text import content_hash
from codestrata.sources import tree_source

# Folders that hold no sources of the project.
IGNORED = ["node_modules", ".git", "__pycache__", ".venv", "venv", ".tox", "dist", "build", ".idea", ".vscode", "vendor", "target"]
#: The store that a project keeps in its own tree.
OWN_FOLDER = ".codestrata"
WATCH_IGNORED = [*IGNORED, ".next", ".nuxt"]
# Marks of generated files.
GENERATED_PATHS = [r"_pb2\.py$", r"_pb2_grpc\.py$", r"[/\\]migrations[/\\]\d+_", r"\.generated\."]
GENERATED_MARKS = ["# Generated by", "# DO NOT EDIT", "# @generated", "// Code generated by"]
MARK_CHARS = 500
TASKS_A_CORE = 2


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """UTF-8 without what is not UTF-8, every line end one line feed: no built-in drops bad bytes."""
    for batch in batches:
        texts = [(b or b"").decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["file", "source"])


def list_times(root: str, ignored: list[str] = IGNORED) -> list[tuple[str, int, int]]:
    """(relative path, bytes, nanoseconds of the last change) of the tree's supported files; ignored folders are not entered.

    For a watcher of one machine's tree; tables of a tree come from ``tree_source``.
    """
    system, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))
    base = base.rstrip("/")
    wanted, found, folders = {e.lower() for e in supported_extensions()}, [], [base]
    while folders:
        for entry in system.get_file_info(pafs.FileSelector(folders.pop())):
            if entry.type == pafs.FileType.Directory:
                if entry.base_name not in ignored and entry.base_name != OWN_FOLDER:
                    folders.append(entry.path)
            elif os.path.splitext(entry.base_name)[1].lower() in wanted:
                found.append((entry.path[len(base) + 1 :], entry.size or 0, entry.mtime_ns or 0))
    return sorted(found)


def languages_in(spark: SparkSession, root: str) -> set[str]:
    """The languages of the tree's files, from the listing alone."""
    listed = tree_source.load(spark, root, [*IGNORED, OWN_FOLDER], content=False)
    return {r["language"] for r in listed.select("language").distinct().collect()}  # at most the known languages


def scan_paths(spark: SparkSession, root: str, ignored: list[str] = IGNORED, languages: list[str] | None = None, prefix: str = "") -> DataFrame:
    """(file, content, language) of the tree's supported files (of some ``languages``, of paths with a ``prefix``); paths are relative to ``root``."""
    listed = tree_source.load(spark, root, [*ignored, OWN_FOLDER], content=False, languages=languages, prefix=prefix)
    # Names are dealt out before files are read: a folder may hold most of the tree.
    dealt = listed.select("file").repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism, "file")
    return tree_source.with_content(dealt, root).select("file", "content", "language")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(file, language, source, sha256) of the files to parse: neither ignored nor generated."""
    decoded = scan_paths(spark, root).select("file", "content").mapInArrow(_decoded, "file string, source string")
    return with_hash(not_generated(decoded)).withColumn("language", language_of(F.col("file"))).select("file", "language", "source", "sha256")


def with_hash(sources: DataFrame) -> DataFrame:
    return sources.withColumn("sha256", content_hash(F.col("source")))


def not_generated(sources: DataFrame, path: str = "file", source: str = "source") -> DataFrame:
    """Without files whose path or first characters mark them as generated."""
    start = F.substring(source, 1, MARK_CHARS)
    named = F.lit(False)
    for pattern in GENERATED_PATHS:
        named = named | F.concat(F.lit("/"), F.col(path)).rlike(pattern)
    for mark in GENERATED_MARKS:
        named = named | start.contains(mark)
    return sources.where(~named)


def scan_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(file, sha256) of the tree's bytes, as the watcher sees it."""
    return scan_paths(spark, root, WATCH_IGNORED).select("file", content_hash(F.col("content")).alias("sha256"))
