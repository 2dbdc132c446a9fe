"""A tree with very many files in a folder: planning keeps no names, files are read by all tasks."""

from codestrata.sources import tree_source, trees


def test_planning_a_tree_keeps_no_file_names(spark, tmp_path, monkeypatch):
    names = [f"src/flat/m{k}.py" for k in range(40)] + [f"src/m{k}.go" for k in range(3)] + ["top.py", "src/flat/deep/x.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    monkeypatch.setattr(tree_source, "LOOKED", 10)
    parts = tree_source.TreeReader(str(tmp_path), []).partitions()
    assert sorted((p.folder, p.deep) for p in parts) == [("", False), ("src", False), ("src/flat", True)]
    found = trees.scan_paths(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r["file"], bytes(r["content"]).decode()) for r in found.collect()) == sorted((n, n) for n in names)


def test_contents_come_in_bounded_batches(tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"m{k}.py").write_text("x" * 100)
    monkeypatch.setattr(tree_source, "BYTES", 150)
    assert [b.num_rows for b in tree_source.contents(str(tmp_path), [*(f"m{k}.py" for k in range(5)), "gone.py"])] == [2, 2, 1]
