"""Watching a tree: file events as a stream, debounced by key, applied batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from codestrata.operators import incremental
from codestrata.sources import trees
from codestrata.streaming import stateful

SETTLED_NS = 2_000_000_000
EVENT_SCHEMA = "file string, kind string, hash string, ts timestamp"


class TreeEvents(DataSource):
    """``spark.readStream.format("tree_events").option("path", root)``: what changed since the last look.

    The offset is the tree's state (by file a hash, size and time), so a restart goes
    on from the last committed look and deletions are seen too. Only files whose
    size or time changed, or that changed so shortly before the last look that a
    second change may have the same time, are read again.
    """

    @classmethod
    def name(cls) -> str:
        return "tree_events"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def simpleStreamReader(self, schema: Any) -> TreeEventReader:
        return TreeEventReader(self.options["path"])


class TreeEventReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def _look(self, before: dict) -> dict:
        import hashlib
        import os
        import time

        import pyarrow.fs as pafs

        system, base = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), os.path.abspath(self.root))
        at, settled = time.time_ns(), before.get("at", 0) - SETTLED_NS
        out = {}
        for name, size, changed in trees.list_times(self.root, trees.WATCH_IGNORED):
            known = before["files"].get(name)
            if known and known[1:] == [size, changed] and 0 < changed < settled:
                out[name] = known
                continue
            try:
                with system.open_input_stream(f"{base.rstrip('/')}/{name}") as file:
                    out[name] = [hashlib.sha256(file.read()).hexdigest()[:16], size, changed]
            except OSError:
                continue
        return {"files": out, "at": at}

    def initialOffset(self) -> dict:
        return {"files": {}, "at": 0}

    def _events(self, before: dict[str, list], now: dict[str, list]) -> list[tuple]:
        ts = pd.Timestamp.now(tz="UTC").to_pydatetime()
        gone = [(f, "delete", h, ts) for f, (h, *_) in sorted(before.items()) if f not in now]
        return gone + [(f, "create" if f not in before else "change", h, ts) for f, (h, *_) in sorted(now.items()) if f not in before or before[f][0] != h]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._look(start)
        return iter(self._events(start["files"], now["files"])), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._events(start["files"], end["files"]))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(0)]


def _micros() -> Column:
    """An event's time as microseconds, whether or not its column has a time zone."""
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("us")


def _times(rows: DataFrame, events: DataFrame) -> Column:
    return F.timestamp_micros(rows["us"]).cast(events.schema["ts"].dataType).alias("ts")


def debounced(events: DataFrame, seconds: float = incremental.DEBOUNCE_SECONDS, forget_after: float | None = None) -> DataFrame:
    """(file, ts) of the accepted events of a stream: leading edge, one state value a file.

    ``forget_after``: seconds of idleness after which a timer drops a file's
    state; such a stream runs until it is stopped. Start it with ``started`` or ``drained``.
    """
    accept = stateful.Debounce(round(seconds * 1e6), None if forget_after is None else max(1, round(forget_after * 1000)))
    keyed = events.select("file", _micros()).groupBy("file")
    rows = keyed.transformWithState(accept, "file string, us long", "Append", "None" if forget_after is None else "ProcessingTime")
    return rows.select("file", _times(rows, events))


def renamed(events: DataFrame, seconds: float = incremental.RENAME_SECONDS, expire: bool = False) -> DataFrame:
    """(hash, old_file, new_file, ts) of a stream of file events: one pending deletion a content, held as state.

    A later deletion of the content takes the pending one's place; a creation
    ends it and is a rename if it comes within ``seconds``, as ``rename_match`` has
    it for a table. With ``expire`` a deletion that nothing followed comes out with
    a null ``new_file`` once a timer is over; such a stream runs until it is stopped.
    """
    match = stateful.Renames(round(seconds * 1e6), max(1, round(seconds * 1000)) if expire else None)
    keyed = events.where("kind in ('delete', 'create')").select("hash", "kind", "file", _micros()).groupBy("hash")
    rows = keyed.transformWithState(match, "hash string, old_file string, new_file string, us long", "Append", "ProcessingTime" if expire else "None")
    return rows.select("hash", "old_file", "new_file", _times(rows, events))


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(window, *by, n) of an event-time stream; a window's state goes, and with it what comes later, once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), *by).agg(F.count("*").alias("n"))


def started(writer: DataStreamWriter) -> StreamingQuery:
    """Starts a query whose state needs the RocksDB store; the session's own setting is as before afterwards (a query keeps its copy)."""
    spark = SparkSession.active()
    name, wanted = stateful.STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        return writer.start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """The rows of a stream once all that its source has now is worked off: ``folder`` gets the rows and the checkpoint.

    Called again with the same folder, the query goes on from its checkpoint:
    what came since is added, nothing is counted twice. A batch is a folder of
    its own, written over if it is repeated after a failure. Rows have
    ``batch``: in ``update`` mode a key's last state is that of its last batch.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = started(stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True))
    query.awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")


class Watcher:
    """Keeps a project's tables up to its tree: each trigger compares the tree with the stored hashes and applies the difference."""

    def __init__(self, spark: SparkSession, project: Any, interval: float = 2.0):
        self.spark, self.project, self.interval = spark, project, interval
        self.query: Any = None

    def start(self, events: bool = False) -> Any:
        """``foreachBatch`` makes each update one transaction of the query.

        A rate stream is the clock, or, with ``events``, the tree's own changes,
        debounced by file: then batches without an accepted event do nothing.
        """
        if events:
            self.spark.dataSource.register(TreeEvents)
            stream = debounced(self.spark.readStream.format("tree_events").option("path", self.project.root).load())
            update = lambda batch, _: self.tick() if batch.count() else None  # noqa: E731  (all partitions must be read for the state to be kept)
        else:
            stream = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            update = lambda *_: self.tick()
        self.query = started(stream.writeStream.trigger(processingTime=f"{self.interval} seconds").foreachBatch(update))
        return self.query

    def tick(self) -> dict[str, int]:
        return self.project.update()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
