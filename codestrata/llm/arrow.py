"""Thin layer over ``mapInArrow``: columns by name, rows out as plain lists or arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 1000

_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What this worker's tasks of one stage share: made by the first of them. A stage's ``keeps`` names it; other stages' tasks drop it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _forget(keeps: tuple) -> None:
    """Workers are reused: what an earlier stage made for its tasks would stay beside all that later ones need."""
    gone = [key for key in _kept if key != keeps]
    for key in gone:
        del _kept[key]
    if gone:
        _release()


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as bytes; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, or longer ones where the table has columns of such names already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(table: DataFrame) -> DataFrame:
    """A plain scan, dealt out anew only where it has fewer splits than the cluster has cores (a small table in one row group)."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def _fitted(values: object, kind: pa.DataType) -> pa.Array:
    """The values as an array of the type; a column that is passed on keeps its time zone and its nested types."""
    if not isinstance(values, pa.Array):
        return pa.array(values, type=kind)
    return values if pa.types.is_timestamp(kind) or pa.types.is_nested(kind) else values.cast(kind)


def _release() -> None:
    """Gives a finished task's free memory back to the system: workers are reused, and what they keep adds up over stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def _small_batches(spark: SparkSession) -> None:
    """Rows are whole texts: a batch of Spark's default of 10,000 would hold tens of megabytes in the JVM and again in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_rows(df: DataFrame, schema: str | T.StructType, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], keeps: tuple = ()) -> DataFrame:
    """``function`` turns record batches into dicts of columns, each dict one output batch. ``keeps``: the key of what its tasks share in a worker (``kept``)."""
    _small_batches(df.sparkSession)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wanted = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget(keeps)
        for made in function(batches):
            columns = [_fitted(made[f.name], f.type) for f in wanted]
            yield pa.RecordBatch.from_arrays(columns, names=wanted.names)
        _release()

    return df.mapInArrow(run, kind)
