"""Keeping a graph up to date: snapshot differences, renames, debounce, re-indexing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import extract, store

DEBOUNCE_SECONDS = 1.0
RENAME_SECONDS = 5.0


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change): ``changed`` (new or another hash) or ``deleted``, from two (file, sha256) tables."""
    old = before.select("file", F.col("sha256").alias("_old"))
    new = after.select("file", F.col("sha256").alias("_new"))
    change = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")), "changed")
    return old.join(new, "file", "full").select("file", change.alias("change")).where(F.col("change").isNotNull())


def rename_match(events: DataFrame, seconds: float = RENAME_SECONDS) -> DataFrame:
    """(hash, old_file, new_file, ts): creations that follow a deletion of the same content within the time.

    ``events``: (kind ``delete`` or ``create``, file, hash, ts). One content has
    one pending deletion: a later one replaces it, a creation takes it. So a
    creation is a rename exactly if the event before it is a deletion in time.
    """
    w = W.partitionBy("hash").orderBy("ts", "kind", "file")
    seen = events.withColumns({"_kind": F.lag("kind").over(w), "_file": F.lag("file").over(w), "_ts": F.lag("ts").over(w)})
    in_time = F.col("ts") <= F.col("_ts") + F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    return seen.where((F.col("kind") == "create") & (F.col("_kind") == "delete") & in_time).select("hash", F.col("_file").alias("old_file"), F.col("file").alias("new_file"), "ts")


def moved(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new): of the ``snapshot_diff`` the deleted files whose content a new file has, one pair a content."""
    gone = changes.where("change = 'deleted'").join(before, "file").groupBy("sha256").agg(F.max("file").alias("old"))
    fresh = changes.where("change = 'changed'").join(before, "file", "left_anti").join(after, "file").groupBy("sha256").agg(F.min("file").alias("new"))
    return gone.join(fresh, "sha256").select("old", "new")


def debounce(events: DataFrame, seconds: float = DEBOUNCE_SECONDS, key: str = "file", time: str = "ts") -> DataFrame:
    """(key, time) of the accepted events: the first, then each that comes ``seconds`` or more after the last accepted one.

    Sorted partitions pass as a stream of Arrow batches. Inside a batch the next
    accepted event is found by binary search, so long bursts cost their accepted
    events; between batches one key and one time are held. Null times go.
    """
    gap = np.timedelta64(round(seconds * 1e6), "us")
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_time, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times = batch.column(0), batch.column(1).cast(pa.timestamp("us", tz="UTC")).to_numpy(zero_copy_only=False).astype("datetime64[us]")
            ends = [r.as_py() for r in pc.run_end_encode(keys).run_ends]
            taken, at = [], 0
            for end in ends:
                name = keys[at].as_py()
                if not (begun and name == last_key):
                    begun, last_key, last_time = True, name, None
                while at < end:
                    if last_time is not None:
                        at += int(np.searchsorted(times[at:end], last_time + gap))
                    if at < end:
                        taken.append(at)
                        last_time, at = times[at], at + 1
                at = end
            yield batch.take(pa.array(taken, pa.int64()))

    rows = events.select(key, time).where(F.col(time).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, time).mapInArrow(run, f"`{key}` {kind[key]}, `{time}` {kind[time]}")


def reindex(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, changed_sources: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after files changed or went: their rows are cleared, changed files parsed, and all call edges resolved anew.

    ``changed_sources``: (file, language, source, sha256); ``deleted``: (file).
    """
    gone = changed_sources.select("file").union(deleted.select("file")).distinct()
    new_nodes, new_edges = extract.parse(changed_sources)
    kept_vectors = store.clear_embeddings(embeddings, nodes, gone)
    all_nodes = store.clear_files(nodes, gone).unionByName(new_nodes.select(*nodes.columns))
    # Targets may have come or gone anywhere, so resolution starts from unresolved edges.
    kept = store.clear_files(edges, gone)
    calls = kept.where("type = 'calls'").groupBy("file", "line", "from_name", "to_name", "type", "id").agg(F.first("from_id").alias("from_id")).withColumn("to_id", F.lit(""))
    base = kept.where("type <> 'calls'").unionByName(calls.select(*kept.columns))
    fresh = extract.numbered(new_edges).select(*kept.columns)
    return all_nodes, extract.resolve(all_nodes, base.unionByName(fresh)), kept_vectors

