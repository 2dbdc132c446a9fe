"""A batch data source of source trees: folders are partitions, choices of path and language reach the listing.

Spark's own file sources pass over names that begin with ``_`` or ``.``, as
package files do. Planning looks for folders only, level by level until there are
``FOLDERS`` of them, and keeps no file's name: a folder above those is a partition
for its own files, one of those for all below it, and so is a folder with more than
``LOOKED`` entries. Tasks list names as a stream and read in bounded batches. So
neither the driver nor a task holds the tree's names. ``with_content`` reads files
that are listed as rows; these can be dealt out first, so that a folder of very many
files is read by all tasks.

Choices are options of the source. Filters are not taken from the plan
(``pushFilters``): in Spark 4.1 what one query pushes stays with the table and
would cut the rows of the next query on it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codestrata.functions.languages import EXTENSIONS

FOLDERS, LOOKED = 256, 10_000
#: Files of a batch: by number (of names alone, twice as many as a batch of Spark's) and by bytes.
NAMES, BYTES = 4096, 1 << 20
LANGUAGE_OF = {e.lower(): language for language, extensions in reversed(EXTENSIONS.items()) for e in extensions}


@dataclass
class Part(InputPartition):
    """A folder's files, or with ``deep`` all below it too; its path is relative to the root."""

    folder: str = ""
    deep: bool = True


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("path", root)``: (file, language, content) of the files of known languages.

    ``ignored``: a JSON list of folder names that are not entered; ``languages``: a
    JSON list of those to read; ``prefix``: how paths begin; ``content``: ``false``
    lists without reading (contents are null). Files that cannot be read are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file string, language string, content binary"

    def reader(self, schema: Any) -> TreeReader:
        given = self.options
        return TreeReader(given["path"], json.loads(given.get("ignored", "[]")), given.get("content", "true").lower() == "true", json.loads(given.get("languages", "null")), given.get("prefix", ""))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, ignored: list[str], content: bool = True, languages: list[str] | None = None, prefix: str = ""):
        self.root, self.ignored, self.content, self.prefix = root, frozenset(ignored), content, prefix
        self.languages = None if languages is None else frozenset(languages)

    def _entries(self, folder: str) -> Iterator[tuple[bool, str]]:
        """(whether it is a folder, path) of what is wanted in a folder, one after the other."""
        for is_folder, name in _listed(*system_of(self.root), folder):
            path = f"{folder}/{name}" if folder else name
            if is_folder:
                # A folder is on the way to the prefix, or below it.
                if name not in self.ignored and (self.prefix.startswith(f"{path}/") or f"{path}/".startswith(self.prefix)):
                    yield True, path
            else:
                language = language_of_name(name)
                if language and path.startswith(self.prefix) and (self.languages is None or language in self.languages):
                    yield False, path

    def _folders(self, folder: str) -> list[str] | None:
        """The folders in a folder, or none said where it has too many entries to look at."""
        found = []
        for seen, (is_folder, name) in enumerate(_listed(*system_of(self.root), folder)):
            if seen >= LOOKED:
                return None
            path = f"{folder}/{name}" if folder else name
            if is_folder and name not in self.ignored and (self.prefix.startswith(f"{path}/") or f"{path}/".startswith(self.prefix)):
                found.append(path)
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        level, parts = [""], []
        while level and len(level) < FOLDERS:
            following: list[str] = []
            for folder in level:
                below = self._folders(folder)
                parts.append(Part(folder, deep=below is None))
                following += below or []
            level = following
        return [*parts, *(Part(folder) for folder in level)]

    def _names(self, part: Part) -> Iterator[str]:
        folders = [part.folder]
        while folders:
            for is_folder, path in self._entries(folders.pop()):
                if not is_folder:
                    yield path
                elif part.deep:
                    folders.append(path)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        named = iter(self._names(partition))
        while names := list(islice(named, NAMES)):
            if self.content:
                yield from contents(self.root, names)
            else:
                yield _batch(names, [None] * len(names))


def system_of(root: str) -> tuple[pafs.FileSystem, str]:
    system, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))
    return system, base.rstrip("/")


def language_of_name(path: str) -> str | None:
    return LANGUAGE_OF.get(os.path.splitext(path)[1].lower())


def _listed(system: pafs.FileSystem, base: str, folder: str) -> Iterator[tuple[bool, str]]:
    """(whether it is a folder, name) of a folder's entries; a local folder is read as a stream."""
    place = f"{base}/{folder}" if folder else base
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(place or "/") as entries:
            for entry in entries:
                yield entry.is_dir(), entry.name
    else:
        for entry in system.get_file_info(pafs.FileSelector(place)):
            yield entry.type == pafs.FileType.Directory, entry.base_name


def _batch(names: list[str], found: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(map(language_of_name, names)), pa.string()), pa.array(found, pa.binary())], names=["file", "language", "content"])


def contents(root: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(file, language, content) of these files, in batches of about ``BYTES``."""
    system, base = system_of(root)
    kept: list[str] = []
    found: list[bytes | None] = []
    size = 0
    for name in names:
        try:
            with system.open_input_stream(f"{base}/{name}", compression=None) as file:
                content = file.read()
        except OSError:
            continue
        kept.append(name)
        found.append(content)
        size += len(content)
        if size >= BYTES:
            yield _batch(kept, found)
            kept, found, size = [], [], 0
    if kept:
        yield _batch(kept, found)


def with_content(listed: DataFrame, root: str) -> DataFrame:
    """(file, language, content) of files listed as rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from contents(root, batch.column(0).to_pylist())

    return listed.select("file").mapInArrow(read, "file string, language string, content binary")


def load(spark: SparkSession, root: str, ignored: list[str], content: bool = True, languages: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The tree as a table, of some languages and of paths with a prefix where these are given."""
    spark.dataSource.register(SourceTree)
    options = {"path": root, "ignored": json.dumps(ignored), "content": str(content).lower(), "languages": json.dumps(languages), "prefix": prefix}
    return spark.read.format("source_tree").options(**options).load()
