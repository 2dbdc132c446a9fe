"""Near copies: fingerprints by the pigeonring give pairs, and keys with one group are one key."""

from codestrata.llm import near_copies, simhash
from codestrata.llm.scratch import Scratch


def test_keys_of_one_group_are_one(spark):
    passage = [(key, fp) for key in range(50) for fp in (7, 8, 9)]
    others = [(100, 7), (100, 8), (101, 8), (101, 9), (102, 7), (102, 8), (102, 9), (102, 10)]
    members = spark.createDataFrame(passage + others, "key long, fp long")
    assert sorted(map(tuple, near_copies.one_key_a_group(members).collect())) == [(0, 3), (100, 2), (101, 2), (102, 4)]


def test_fingerprints_give_pairs(spark):
    """Classes that are linked by their SimHashes are verified, whether or not they share a key."""
    flipped = lambda x, *bits: x ^ sum(1 << b for b in bits)
    base = 0x0123456789ABCDEF
    rows = [(1, base), (2, base), (3, flipped(base, 0, 20, 40, 60)), (4, flipped(base, 0, 9, 20, 40, 60)), (5, flipped(base, *range(0, 64, 4)))]
    pairs = near_copies.fingerprint_pairs(spark.createDataFrame(rows, "fp long, sim long"), Scratch(spark, "test"))
    found = {tuple(r) for r in pairs.collect()}
    assert {(1, 2), (1, 3)} <= found and found <= {(1, 2), (1, 3), (3, 4)} and (3, 4) in found


def test_near_dedup_goes_through_the_pigeonring(spark, monkeypatch):
    asked = []
    through = simhash.hamming_links
    monkeypatch.setattr(simhash, "hamming_links", lambda *given: asked.append(1) or through(*given))
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "something else")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(docs).collect()) == [1, 3] and asked
