"""Streams that stop by themselves: file events, debounce with state, event-time counts."""

import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from codestrata.operators import incremental
from codestrata.streaming import stateful
from codestrata.streaming.watch import EVENT_SCHEMA, TreeEvents, Watcher, debounced, drained, event_counts, renamed, started


def at(seconds):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=seconds)).to_pydatetime()


def add_file(spark, rows, schema, folder, number):
    """One more file of a stream's source, younger than those before."""
    made = folder.parent / f"made-{number}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(made))
    (file,) = made.glob("*.parquet")
    folder.mkdir(exist_ok=True)
    os.utime(file, (1_700_000_000 + number * 60,) * 2)
    file.rename(folder / f"{number}.parquet")


def source(spark, folder, schema=EVENT_SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_debounce_stream(spark, tmp_path):
    before = spark.conf.get(stateful.STORE[0])
    rows = [(f, "change", "h", at(s)) for f, s in [("a", 0), ("a", 0.9), ("a", 1.0), ("b", 0.2), ("a", 2.5), (None, 1)]]
    add_file(spark, rows, EVENT_SCHEMA, tmp_path / "in", 0)
    got = drained(debounced(source(spark, tmp_path / "in")), f"file://{tmp_path}/out").collect()
    assert sorted((r["file"] or "", (r["ts"] - at(0)).total_seconds()) for r in got) == [("", 1.0), ("a", 0.0), ("a", 1.0), ("a", 2.5), ("b", 0.2)]
    assert spark.conf.get(stateful.STORE[0]) == before


def test_restart_from_the_checkpoint(spark, tmp_path):
    """A query that is stopped and started again, with files that came meanwhile, gives the rows of one run, and those of the table."""
    r = random.Random(3)
    parts = [[(r.choice("abc"), r.choice(["delete", "create", "change"]), r.choice("gh"), at(60 * k + r.randrange(600) / 10)) for _ in range(60)] for k in range(4)]
    shapes = {"debounce": (debounced, incremental.debounce), "renames": (renamed, lambda t: incremental.rename_match(t.where("kind <> 'change'")))}
    for k, part in enumerate(parts):
        add_file(spark, part, EVENT_SCHEMA, tmp_path / "in", k)
        if k % 2:  # two files, then two more from the checkpoint
            for name, (stream, _) in shapes.items():
                drained(stream(source(spark, tmp_path / "in")), f"file://{tmp_path}/{name}")
    table = spark.read.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    for name, (stream, batch) in shapes.items():
        want = sorted(map(tuple, batch(table).collect()))
        for folder in (name, f"{name}-once"):
            got = drained(stream(source(spark, tmp_path / "in")), f"file://{tmp_path}/{folder}").drop("batch")
            assert want and sorted(map(tuple, got.collect())) == want


def test_renames_over_batches(spark, tmp_path):
    """The pending deletion of a content is state: it outlives a micro-batch, is replaced by a later one and ended by a creation."""
    parts = [
        [("old", "delete", "h", at(0)), ("p", "delete", "g", at(0)), ("r", "delete", "k", at(0)), ("x", "change", "h", at(1))],
        [("new", "create", "h", at(4)), ("q", "create", "g", at(9)), ("s", "delete", "k", at(1))],
        [("u", "create", "k", at(2)), ("v", "create", "k", at(3)), ("new2", "create", "h", at(4.5))],
    ]
    for k, part in enumerate(parts):
        add_file(spark, part, EVENT_SCHEMA, tmp_path / "in", k)
    got = drained(renamed(source(spark, tmp_path / "in")), f"file://{tmp_path}/out").drop("batch")
    table = spark.read.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in")).where("kind <> 'change'")
    assert set(map(tuple, got.collect())) == set(map(tuple, incremental.rename_match(table).collect()))
    assert {(r["old_file"], r["new_file"]) for r in got.collect()} == {("old", "new"), ("s", "u")}


def test_pending_deletions_expire(spark, tmp_path):
    """A timer hands out a deletion that no creation followed, and drops its state."""
    add_file(spark, [("gone", "delete", "h", at(0)), ("a", "delete", "g", at(0))], EVENT_SCHEMA, tmp_path / "in", 0)
    add_file(spark, [("b", "create", "g", at(1))], EVENT_SCHEMA, tmp_path / "in", 1)
    query = started(renamed(source(spark, tmp_path / "in"), 3.0, expire=True).writeStream.format("memory").queryName("expired").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="1 second"))
    end = time.monotonic() + 120
    while spark.table("expired").count() < 2 and time.monotonic() < end and query.isActive:
        time.sleep(1)
    query.stop()
    assert {(r["old_file"], r["new_file"]) for r in spark.table("expired").collect()} == {("a", "b"), ("gone", None)}


def test_event_counts(spark, tmp_path):
    """Counts over several micro-batches, exact users included, are those of the table."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "user_id")
    rows = events.collect()
    for k in range(3):
        add_file(spark, rows[k::3], events.schema, tmp_path / "in", k)
    states = drained(event_counts(source(spark, tmp_path / "in", events.schema), "1 day", "366 days", ("event_type", "user_id")), f"file://{tmp_path}/out", "update")
    got = states.groupBy("window", "event_type", "user_id").agg(F.max_by("n", "batch").alias("n"))
    want = events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type", "user_id").count()
    assert sorted(map(str, got.select("window.start", "event_type", "user_id", "n").collect())) == sorted(map(str, want.toDF("start", "event_type", "user_id", "n").collect()))


def test_tree_events(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("x = 1\n")
    reader = TreeEvents({"path": str(tree)}).simpleStreamReader(None)
    first, state = reader.read(reader.initialOffset())
    assert [(e[0], e[1]) for e in first] == [("a.py", "create")]
    (tree / "a.py").write_text("x = 2\n")
    (tree / "b.py").write_text("")
    second, later = reader.read(state)
    assert [(e[0], e[1]) for e in second] == [("a.py", "change"), ("b.py", "create")]
    (tree / "a.py").unlink()
    third, _ = reader.read(later)
    assert [(e[0], e[1]) for e in third] == [("a.py", "delete")]
    assert [e[1] for e in reader.readBetweenOffsets(state, later)] == ["change", "create"]


def test_watcher_ticks(spark):
    class Fake:
        ticks = 0

        def update(self):
            self.ticks += 1
            return {}

    fake = Fake()
    watcher = Watcher(spark, fake, 0.2)
    query = watcher.start()
    for _ in range(60):
        if fake.ticks:
            break
        query.awaitTermination(1)
    watcher.stop()
    assert fake.ticks and watcher.query is None


def test_watcher_on_events(spark, tmp_path):
    """Changes of the tree, debounced, drive the updates; without changes there are none."""
    class Fake:
        root, ticks = str(tmp_path), 0

        def update(self):
            self.ticks += 1
            return {}

    (tmp_path / "a.py").write_text("x = 1\n")
    fake = Fake()
    watcher = Watcher(spark, fake, 0.2)
    query = watcher.start(events=True)

    def settles(n):
        end = time.monotonic() + 90
        while fake.ticks < n and time.monotonic() < end and query.isActive:
            time.sleep(0.3)
        return fake.ticks

    assert settles(1) == 1
    time.sleep(1.5)
    (tmp_path / "a.py").write_text("x = 2\n")
    assert settles(2) == 2
    watcher.stop()


def test_unchanged_files_are_not_read_again(tmp_path):
    reader = TreeEvents({"path": str(tmp_path)}).simpleStreamReader(None)
    (tmp_path / "a.py").write_text("x = 1\n")
    os.utime(tmp_path / "a.py", (1_700_000_000,) * 2)
    _, state = reader.read(reader.initialOffset())
    (tmp_path / "a.py").write_text("x = 2\n")
    os.utime(tmp_path / "a.py", (1_700_000_000,) * 2)
    events, state = reader.read(state)
    assert list(events) == []  # same size and time: not read
    os.utime(tmp_path / "a.py", (1_700_000_009,) * 2)
    events, _ = reader.read(state)
    assert [(e[0], e[1]) for e in events] == [("a.py", "change")]
