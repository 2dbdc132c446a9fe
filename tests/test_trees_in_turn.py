"""Trees of many files stand one after the other."""

import os

import pytest

import __spark_entry__ as entry
from codestrata.plans import fixtures
from codestrata.sources import trees

DATA = "/root/testdata/sf0.001"


def files_below(folder):
    return [os.path.join(at, name) for at, _, names in os.walk(folder) for name in names if not name.endswith((".parquet", ".crc")) and name != "_SUCCESS"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["tree_sources", "tree_hashes", "tree_of_one_language"])
def test_files_at_one_time_do_not_grow_with_the_table(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(fixtures.shared, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    whole = sorted(map(tuple, entry.queries()[name](spark, DATA).collect()))
    monkeypatch.setattr(fixtures.shared, "new_folder", lambda spark, name: f"file://{tmp_path}/again-{name}")
    monkeypatch.setattr(fixtures, "TREE_CUSTOMERS", 40)
    seen = []
    through = trees.scan_paths

    def scan(*given, **named):
        seen.append(len(files_below(tmp_path / "again-trees")))
        return through(*given, **named)

    monkeypatch.setattr(trees, "scan_paths", scan)
    assert sorted(map(tuple, entry.queries()[name](spark, DATA).collect())) == whole and whole
    customers = spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert len(seen) == -(-customers // 40) and sum(seen) == customers * 8 and max(seen) < customers * 8 / 2
    assert len(files_below(tmp_path / "again-trees")) == seen[-1]
