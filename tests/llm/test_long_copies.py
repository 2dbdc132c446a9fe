"""Near copies among long texts: what is compared in whole, and that no pair is lost."""

import random

from codestrata.llm import near_copies


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(50_000)}" for _ in range(n)]


def test_long_texts_with_one_passage_are_not_compared_in_whole(spark, monkeypatch):
    """Parities of a fixed number of bits say nothing of long sets, so every pair with a common shingle was."""
    seen = []
    through = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, sets: seen.append(pairs.count()) or through(pairs, sets))
    texts = [" ".join([*words(k, 1500), "a", "rare", "passage", "of", "six", "words", *words(-k - 1, 1500)]) for k in range(12)]
    rows = spark.createDataFrame(list(enumerate([*texts, f"{texts[0]} end"])), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(rows).collect()) == list(range(12))
    assert sum(seen) <= 2


def test_long_near_copies_are_found(spark):
    """Sizes on both sides of a power of two, similarities on both sides of the bound."""
    texts, sets = [], []
    for k, (n, cut, more) in enumerate([(2100, 250, 0), (2100, 0, 500), (2100, 0, 530), (4200, 800, 30), (4200, 860, 0), (9000, 900, 800), (9000, 1000, 1100), (1000, 0, 60), (1030, 20, 180)]):
        base = words(100 + k, n)
        for text in (base, base[cut:] + words(200 + k, more)):
            texts.append(" ".join(text))
            sets.append({tuple(text[j : j + 5]) for j in range(len(text) - 4)})
    near = [5 * len(sets[k] & sets[k + 1]) >= 4 * len(sets[k] | sets[k + 1]) for k in range(0, len(sets), 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in near_copies.one_of_each(rows).collect()}
    assert 3 <= sum(near) <= 7 and kept == {k for k in range(len(texts)) if k % 2 == 0 or not near[k // 2]}


def test_parities_of_other_sizes_are_folded():
    a, b = (near_copies.shingle_sets([" ".join(words(k, n)).encode()])[0] for k, n in ((1, 1500), (2, 3000)))
    own, other = near_copies.own_parities(a), near_copies.own_parities(b)
    assert (len(own), len(other)) == (2048 // 8, 4096 // 8)
    plain = sum(x != y for s, o in zip(near_copies.parities(a, 2048), near_copies.parities(b, 2048), strict=True) for x, y in zip(f"{s:08b}", f"{o:08b}", strict=True))
    assert near_copies.differing(own, other) == near_copies.differing(other, own) == plain
    assert near_copies.own_parities(a[:1000]) == near_copies.own_parities(a[:0]) == b""


def test_the_first_common_key_of_a_group_stays(spark):
    """Of keys with the same members the first decides whether enough is left behind it."""
    members = spark.createDataFrame([(1, 7, 90), (1, 8, 80), (2, 7, 3), (2, 8, 2), (3, 7, 5), (3, 9, 4)], "key long, fp long, p int")
    assert sorted(map(tuple, near_copies.one_key_a_group(members).collect())) == [(2, 2), (3, 2)]
