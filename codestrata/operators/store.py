"""The graph's tables as Parquet snapshots, and changes to them as plans.

A change reads one snapshot and writes the next one of the tables that it touches,
each in a folder of its own. A manifest names the folders of all tables; a change
ends with the manifest of the next number, which is created whole under a name of
its own and then renamed to that number, so readers see the tables of one moment
and a failed change leaves no trace. Folders go when the manifests that name them
are more than ``KEPT`` changes old, so readers of the snapshots before end in
peace. Source files are the unit of change: rows of a changed file are replaced by
an anti-join on the file, in the data files that hold some of them; the others
stay as they are and are named by the next manifest too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import cost
from codestrata.schemas import ACTIVITY, TABLES


KEPT = 2
#: Up to so many changed files are looked for by their names; a table in more places than ``MANY`` is written whole.
FEW, MANY = 1000, 10_000
#: So many log files are made one.
LOG_FILES = 64


def one_by(new: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the one with the greatest ``order`` (or of all columns), whatever the order of rows."""
    rows = F.struct(*new.columns)
    return new.groupBy(F.col(key).alias("_key")).agg(F.max_by(rows, F.struct(*(order or new.columns))).alias("_row")).select("_row.*")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` take the place of rows with their id; of several with one id the last by file and line stays."""
    last = one_by(new, "id", *(c for c in ("file", "line") if c in new.columns), *(c for c in new.columns if c not in ("file", "line")))
    return nodes.join(last.select("id"), "id", "left_anti").unionByName(last)


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new)


def clear_files(table: DataFrame, files: DataFrame, column: str = "file") -> DataFrame:
    """Without the rows of these files."""
    return table.join(files.select(F.col("file").alias(column)).distinct(), column, "left_anti").select(*table.columns)


def clear_embeddings(embeddings: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Without the vectors of these files' nodes."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("node_id"))
    return embeddings.join(gone, "node_id", "left_anti").select(*embeddings.columns)


def rename_file(table: DataFrame, old: str, new: str) -> DataFrame:
    """The file's rows under its new name; ids stay."""
    return table.withColumn("file", F.when(F.col("file") == old, F.lit(new)).otherwise(F.col("file")))


def rename_files(table: DataFrame, moves: DataFrame) -> DataFrame:
    """The rows of the files ``old`` under their names ``new``, of many files in one join."""
    names = moves.select(F.col("old").alias("file"), F.col("new").alias("_new"))
    return table.join(names, "file", "left").withColumn("file", F.coalesce("_new", "file")).select(*table.columns)


def upsert_by(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` take the place of rows with their key."""
    last = one_by(new.select(*table.columns), key)
    return table.join(last.select(key), key, "left_anti").select(*table.columns).unionByName(last)


def file_hash(hashes: DataFrame, file: str) -> DataFrame:
    """(file, sha256) of one file, if it is known: a point look-up that reaches the scan."""
    return hashes.where(F.col("file") == file).select("file", "sha256")


class Manifests:
    """Numbered manifests below a folder: each is written whole under a name of its own, then renamed to the next number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Of the manifests that there are, ascending."""
        _, target, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(target):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(target)]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number}").first()[0])

    def current(self) -> dict:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else {}

    def commit(self, made: dict) -> int:
        """Writes the next manifest and returns its number; another change that came first with it is an error."""
        numbers = self.numbers()
        number = numbers[-1] + 1 if numbers else 0
        jvm, target, fs = self._fs(f"{self.path}/manifests/{number}")
        following = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/next-{uuid.uuid4().hex}")
        out = fs.create(following, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(following, target):
            fs.delete(following, False)
            raise RuntimeError(f"another change of {self.path} was written first; read its tables and try again")
        return number

    def retire(self, folders: Callable[[dict], set[str]]) -> None:
        """Deletes the manifests that are more than ``KEPT`` changes old, and the folders that only they name."""
        numbers = self.numbers()
        old = [n for n in numbers if n < numbers[-1] - KEPT]
        used = {f for n in numbers if n not in old for f in folders(self.read(n))}
        for n in old:
            for folder in folders(self.read(n)) - used:
                self.delete(f"{self.path}/{folder}")
            self.delete(f"{self.path}/manifests/{n}")

    def delete(self, path: str) -> None:
        _, target, fs = self._fs(path)
        fs.delete(target, True)


@dataclass(frozen=True)
class Replaced:
    """A change of a table: the rows of ``files`` (file) go, ``rows`` come."""

    files: DataFrame
    rows: DataFrame


class Store:
    """Snapshots of all tables below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path)

    def snapshot(self) -> dict[str, Any]:
        """The folder, or the data files and folders, of each table at this moment."""
        return self.manifests.current()

    def _paths(self, table: str, snapshot: dict[str, Any] | None = None) -> list[str]:
        """Where the table's rows are: a folder, or data files of several folders."""
        found = (self.snapshot() if snapshot is None else snapshot).get(table, [])
        return [f"{self.path}/{table}/{place}" for place in ([found] if isinstance(found, str) else found)]

    def read(self, table: str, snapshot: dict[str, Any] | None = None) -> DataFrame:
        """The table, of this moment or of a ``snapshot`` taken before; empty if it was never written."""
        paths = self._paths(table, snapshot)
        if not paths:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*paths)

    @contextmanager
    def staged(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Writes tables that only one change needs and reads them back; they go when it ends."""
        folder = f"{self.path}/staged/{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            place = f"{folder}/{uuid.uuid4().hex}"
            df.write.parquet(place)
            return self.spark.read.schema(df.schema).parquet(place)

        try:
            yield keep
        finally:
            self.manifests.delete(folder)

    def write(self, table: str, rows: DataFrame, by: str | None = None) -> None:
        """Writes the table's next snapshot and switches to it."""
        self.write_all({table: (rows, by)})

    def write_all(self, tables: dict[str, tuple[DataFrame | Replaced, str | None]]) -> None:
        """Writes the next snapshots of several tables, all from the current ones, then switches to them at once.

        A snapshot is clustered by its column, so that look-ups read few row
        groups. Of a table of which only some source files' rows are ``Replaced``,
        only the data files that hold such rows are written anew.
        """
        written: dict[str, Any] = {}
        for table, (rows, by) in tables.items():
            written[table] = self._replace(table, rows, by) if isinstance(rows, Replaced) else self._folder(table, rows, by)
        self._commit(written)

    def _folder(self, table: str, rows: DataFrame, by: str | None) -> str:
        name = f"snapshot-{uuid.uuid4().hex}"
        columns = rows.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[table].fields))
        if by:
            columns = columns.repartitionByRange(by).sortWithinPartitions(by)
        writer = columns.write
        if "file" in columns.columns:  # finds a source file's rows where a table is clustered by another column
            writer = writer.option("parquet.bloom.filter.enabled#file", "true").option("parquet.bloom.filter.expected.ndv#file", "20000")
        writer.parquet(f"{self.path}/{table}/{name}")
        return name

    def _replace(self, table: str, change: Replaced, by: str | None) -> list[str] | str:
        """The data files that stay, and a folder of the rows that are new or stood in a data file with replaced ones.

        Which data files those are, a scan says that prunes by their bounds and
        Bloom filters. A table in very many places is written whole.
        """
        current = self.read(table)
        keys = [r["file"] for r in change.files.select("file").distinct().limit(FEW + 1).collect()]
        held = current.where(F.col("file").isin(keys)) if len(keys) <= FEW else current.join(change.files, "file", "left_semi")
        place = lambda path: path.rpartition(f"/{table}/")[2]
        touched = {place(r["file_path"]) for r in held.select("_metadata.file_path").distinct().collect()} if self._paths(table) else set()
        stay = [p for p in map(place, current.inputFiles()) if p not in touched]
        if len(stay) > MANY:
            return self._folder(table, clear_files(current, change.files).unionByName(change.rows.select(*current.columns)), by)
        rows = change.rows.select(*current.columns)
        if touched:
            rows = clear_files(self.spark.read.schema(TABLES[table]).parquet(*(f"{self.path}/{table}/{p}" for p in sorted(touched))), change.files).unionByName(rows)
        return [*stay, self._folder(table, rows, by)]

    def _commit(self, written: dict[str, Any]) -> None:
        """Names the tables' new folders in the next manifest; folders that only old manifests name go."""
        self.manifests.commit(self.manifests.current() | written)
        self.manifests.retire(lambda made: {f"{table}/{place.partition('/')[0]}" for table, places in made.items() for place in ([places] if isinstance(places, str) else places)})

    def log(self, op: str, target: str | None, time_ms: float, files_with: int, files_without: int, source: str = "web", extra: dict | None = None) -> None:
        """Appends one activity entry: one small file."""
        c = F.lit
        entries = cost.log_entry(c(op), c(target or ""), c(source), c(float(time_ms)), c(files_with), c(files_without), F.create_map(*[c(str(x)) for kv in (extra or {}).items() for x in kv]) if extra else F.create_map().cast("map<string,string>"))
        stamp = datetime.now()
        row = self.spark.range(0, 1, 1, 1).select(c(int(stamp.timestamp() * 1e6)).alias("id"), c(stamp.strftime("%H:%M:%S")).alias("ts"), *(v.alias(k) for k, v in entries.items()))
        row.select(*(F.col(f.name).cast(f.dataType) for f in ACTIVITY.fields)).write.mode("append").parquet(f"{self.path}/activity_log/entries")
        self._compact_log()

    def _log_files(self) -> list[str]:
        _, target, fs = self.manifests._fs(f"{self.path}/activity_log/entries")
        return [str(s.getPath().toString()) for s in fs.listStatus(target) if s.getPath().getName().endswith(".parquet")] if fs.exists(target) else []

    def _compact_log(self) -> None:
        """Makes many entries' files one. Readers drop repeats, so those that stand twice for a moment count once."""
        files = self._log_files()
        if len(files) < LOG_FILES:
            return
        self.spark.read.schema(ACTIVITY).parquet(*files).coalesce(1).write.parquet(f"{self.path}/activity_log/compacted-{uuid.uuid4().hex}")
        for file in files:
            self.manifests.delete(file)

    def activity(self) -> DataFrame:
        """The log; empty if nothing was logged."""
        _, target, fs = self.manifests._fs(f"{self.path}/activity_log")
        folders = [s.getPath().toString() for s in fs.listStatus(target)] if fs.exists(target) else []
        files = [f for f in folders if "/compacted-" in f] + self._log_files()
        if not files:
            return self.spark.createDataFrame([], ACTIVITY)
        return self.spark.read.schema(ACTIVITY).parquet(*files).distinct()
