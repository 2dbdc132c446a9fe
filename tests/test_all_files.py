"""The impact of all files at once: words of files in place of pairs, the same answers as file by file."""

import random

from codestrata.operators import impact

NODES = "name string, file string, type string, line int, signature string, id string"
EDGES = "id long, from_name string, to_name string, type string, file string, line int"


def test_as_file_by_file(spark):
    """Names that stand in one file and names that stand in several, unknown files, tests; more files than a word has bits."""
    r = random.Random(4)
    files = [f"f{k}.py" for k in range(70)]
    homes = {f"g{k}": r.sample(files, r.choice([1, 1, 1, 2, 3])) for k in range(90)}
    nodes = [(n, f, "function", r.randint(1, 40), "", f"{n}{f}") for n, where in homes.items() for f in where] + [("C", f, "class", 0, "", f"C{f}") for f in files]
    names = list(homes)
    edges = []
    for k in range(260):
        a, b = r.choice(names), r.choice([*names, "outside"])
        edges.append((k * 2, a, b, "calls", r.choice([*homes[a], *homes[a], None, ""]), 1))
        if k % 5 == 0:
            edges.append((k * 2 + 1, a, b, "tests", r.choice(homes[a]), 1))
    nodes, edges = spark.createDataFrame(nodes, NODES).cache(), spark.createDataFrame(edges, EDGES).cache()
    got = {row["changed_file"]: row.asDict() for row in impact.analyze_all_files(nodes, edges, keep=lambda df: df.localCheckpoint()).collect()}
    assert set(got) == set(files)
    for file in files[:12]:
        want = impact.risk(impact.analyze_file(nodes, edges, file, keep=lambda df: df.localCheckpoint())).first().asDict()
        assert got[file] == want


def test_a_level_holds_words_not_pairs(spark):
    """Forty files whose functions one name calls: that name's level is one row."""
    nodes = spark.createDataFrame([(f"g{k}", f"f{k}.py", "function", 1, "", f"{k}") for k in range(40)], NODES)
    edges = spark.createDataFrame([(k, "hub", f"g{k}", "calls", "hub.py", 1) for k in range(40)], EDGES)
    kept = []

    def keep(df):
        kept.append(df.localCheckpoint())
        return kept[-1]

    got = impact.analyze_all_files(nodes, edges, keep=keep)
    assert {(r["n_direct"], r["affected_file_count"]) for r in got.collect()} == {(1, 2)}
    assert [df.count() for df in kept if "depth" in df.columns] == [1, 0, 0]
