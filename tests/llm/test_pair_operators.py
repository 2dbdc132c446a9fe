"""Fingerprints, links, lines, leaks, URLs and archives against brute force."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codestrata.llm import decontaminate, line_dedup, minhash, near_copies, queries, simhash, url_filter, warc
from codestrata.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower(text)) if w]


def docs_of(spark, texts, start=0):
    rows = [(start + k, t, "n", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, i int, row int")


# --- SimHash --------------------------------------------------------------------------------------


def plain_simhash(text, width=4):
    w = split(text)
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if h and 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints):
    """{index: smallest linked index} by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(prints))]


def noisy(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice("abc") * r.randint(1, 4)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    base = [" ".join("".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(r.choice([3, 40, 300]))) for _ in range(12)]
    out = [None, "", " \n", "a", "A", "a b c d", "a  B\tc d", "\x1c x\x85y"]
    out += [noisy(r, t, r.randint(0, 3)) for t in base for _ in range(8)] + base + base[:3]
    return out


def test_simhash(spark, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [plain_simhash(t) for t in texts]
    roots = plain_components(prints)
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k]["component_id"] for k in range(len(texts))] == roots
    assert len(set(roots)) < len(texts) - 20


@pytest.mark.parametrize("many", [simhash.MANY, 0])
def test_simhash_large_groups(spark, monkeypatch, many):
    """A dense ball of fingerprints under few keys, dealt in blocks; keys of two and of three segments."""
    monkeypatch.setattr(simhash, "GROUP", 40)
    monkeypatch.setattr(simhash, "MANY", many)
    r = random.Random(4)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = sorted({c ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(250)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    scratch = Scratch(spark, "t")
    links = [(r["a"], r["b"]) for r in simhash.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp long"), scratch).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    rooted = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    roots = plain_components(prints)
    group, want = defaultdict(set), defaultdict(set)
    for k, p in enumerate(signed):
        group[rooted.get(p, p)].add(p)
        want[roots[k]].add(p)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("length", [2, 3])
def test_simhash_chains_lose_nothing(length):
    r = random.Random(9)
    for _ in range(400):
        a = r.getrandbits(64)
        b = a ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 4)))
        keys = [set(simhash.chain_keys(np.array([x], np.uint64), length)[0].tolist()) for x in (a, b)]
        shared = keys[0] & keys[1]
        assert any(simhash.linked(np.array([a], np.uint64), np.array([b], np.uint64), k >> simhash._START)[0] for k in shared)


def test_one_of_each(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (2, "A b c  d e f"), (2, "A b c  d e f"), (None, "a b c d e f"), (7, None), (9, ""), (None, "z y x w v u t"), (None, "z y x w v u t")], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(2, "A b c  d e f"), (7, None), (None, "z y x w v u t")]))
    assert simhash.one_of_each(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_of_equal_rows(spark):
    """Of rows equal in id and text the same one stays, however they are dealt."""
    rows = [(1, "a b c d e f", k, {"k": k}) for k in range(9)] + [(2, "A b c d e f", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int, more map<string,int>")
    kept = {tuple(map(str, simhash.one_of_each(df.repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


# --- near copies ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("group", "small"), [(near_copies.GROUP, 1), (8, 2), (near_copies.GROUP, near_copies.SMALL)])
def test_near_copies(spark, monkeypatch, group, small):
    """The pipeline's stage against all pairs at a Jaccard similarity of 0.8 of five-word shingles."""
    monkeypatch.setattr(near_copies, "GROUP", group)
    monkeypatch.setattr(near_copies, "SMALL", small)
    r = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    common = " ".join(r.choices(words, k=60))
    base = [" ".join(r.choices(words, k=n)) for n in (3, 5, 9, 14, 45, 90, 200, 600) for _ in range(3)]
    texts = [None, "", " \n", "w1", "W1", *base, *(f"{common} {t}" for t in base)]
    for t in base:
        n = len(t.split())
        texts += [noisy(r, t, r.randint(0, 1 + n // 30)) for _ in range(6)] + [t.rsplit(" ", 1 + n // 8)[0], f"{t} {' '.join(r.choices(words, k=1 + n // 7))}"]
    texts += [noisy(r, base[-4], r.randint(0, 6)) for _ in range(60)]
    r.shuffle(texts)

    def shingles(text):
        w = split(text)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    pairs = 0
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs += 1
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x["doc_id"] for x in dict(corpus_pipeline.STAGES)["near_dedup"](spark, rows.repartition(5), DATA).collect()}
    assert pairs > 300 and kept == set(root)


def test_groups_give_forests():
    """A group of copies gives a row a member, one of texts that share a passage none, one component nothing at the second reading."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    copies = [np.concatenate((base[:290], r.integers(0, 1 << 63, 10, dtype=np.uint64))) for _ in range(500)]
    others = [np.concatenate((base[:60], r.integers(0, 1 << 63, 240, dtype=np.uint64))) for _ in range(500)]
    group = lambda sets: {"fp": np.arange(len(sets)), "n": np.full(len(sets), 300), "s": np.frombuffer(b"".join(map(near_copies.parities, sets)), np.uint64).reshape(len(sets), -1), "root": np.arange(len(sets))}
    count = lambda pairs: sum(len(a) for a, _ in pairs)
    assert count(near_copies.spanning(group(copies))) == 499 and count(near_copies.spanning(group(others))) == 0
    assert count(near_copies.between(group(others))) == 0 and count(near_copies.between(group(copies) | {"root": np.zeros(500, int)})) == 0
    assert count(near_copies.between(group(copies[:40]))) == 40 * 39 // 2


# --- MinHash --------------------------------------------------------------------------------------


def test_minhash(spark, texts):
    df = docs_of(spark, texts + ["x " * 3000, "y z"]).repartition(5)
    got = {r["doc_id"]: r for r in minhash.fingerprint_documents(df).collect()}
    given = [r or "" for r in [*texts, "x " * 3000, "y z"]]
    assert len(got) == len(given)
    prints = defaultdict(set)
    for k, text in enumerate(given):
        following = given[(k + 1) % len(given)]
        n = len(text) // 4
        assert got[k]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
        assert got[k]["n_chars"] == len(text)
        prints[text].add(got[k]["fingerprint"])
        shingles = lambda t: {tuple(split(t)[j : j + 5]) for j in range(max(1, len(split(t)) - 4))} if split(t) else set()
        for other, near in ((text[: len(text) - n] + following[:n], got[k]["near_edited"]), (following, got[k]["near_next"])):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.13
    assert all(len(v) == 1 for v in prints.values())


def test_minhash_edges(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    row = minhash.fingerprint_documents(one).first()
    assert row["near_next"] == 1.0
    two = spark.createDataFrame([(1, None), (None, "a b"), (1, None), (None, "")], "doc_id long, text string")
    assert minhash.fingerprint_documents(two).count() == 4
    assert minhash.fingerprint_documents(two.limit(0)).count() == 0


def test_minhash_of_large_ids(spark):
    """Ids that doubles cannot tell apart keep their order; other types are refused."""
    ids = [-(1 << 63), (1 << 63) - 1, (1 << 60) + 2, (1 << 60) + 1, (1 << 60) + 3, 5, -(1 << 53) - 1]
    df = spark.createDataFrame([(k, f"text of {k} with some words more") for k in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in minhash.fingerprint_documents(df).collect()}
    ordered = sorted(ids)
    for k, i in enumerate(ordered):
        text, following = (f"text of {x} with some words more" for x in (i, ordered[(k + 1) % len(ids)]))
        assert got[i] == hashlib.sha256((text[: len(text) - len(text) // 4] + following[: len(text) // 4]).encode()).hexdigest()
    with pytest.raises(ValueError, match="integer"):
        minhash.fingerprint_documents(df.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_densify():
    bins = np.full((3, minhash.BINS), minhash._EMPTY)
    bins[1, 7] = 5
    bins[2, ::2] = np.arange(minhash.BINS // 2)
    out = minhash.densify(bins)
    assert (out[0] == minhash._EMPTY).all() and (out[1] == 5).all() and (out[2] != minhash._EMPTY).all() and (out[2, ::2] == bins[2, ::2]).all()


# --- lines ----------------------------------------------------------------------------------------


def within(a, b):
    if a == b:
        return True
    if max(len(a), len(b)) < line_dedup.LEAST_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("bits", [line_dedup.MAX_BITS, 1 << 12])
def test_lines(spark, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "MAX_BITS", bits)
    r = random.Random(bits)
    pool = [" ".join(r.choices("abcdefgh", k=r.choice([1, 2, 4, 5, 6, 7, 9, 12, 30]))) for _ in range(50)]

    def variant(line):
        w = line.split()
        kind = r.random()
        if kind < 0.3:
            w[r.randrange(len(w))] = r.choice("abcxyz")
        elif kind < 0.5:
            w.pop(r.randrange(len(w)))
        elif kind < 0.7:
            w.insert(r.randint(0, len(w)), r.choice("abxz"))
        return " ".join(w) if r.random() < 0.8 else "  ".join(w).upper()

    rows = []
    for k in range(120):
        lines = [variant(r.choice(pool)) if r.random() < 0.6 else " ".join(r.choices([f"w{j}" for j in range(300)], k=r.randint(1, 14))) for _ in range(r.randint(0, 7))]
        rows.append((None if k == 77 else k, None if k == 50 else "\n".join(lines), "x"))
    rows.append(rows[10])
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lines_in string")).collect()
    place = lambda i, k: (i is None, i or 0, k)
    seen = [(place(i, k), split(line)) for i, t, _ in rows if t is not None for k, line in enumerate(t.split("\n")) if split(line)]
    want = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if not split(x) or not any(p < place(i, k) and within(split(x), w) for p, w in seen)]
        want.append((i, None if t is None else "\n".join(kept), len(lines), len(kept)))
    assert sorted(map(str, ((r["doc_id"], r["text"], r["lines_in"], r["lines_out"]) for r in got))) == sorted(map(str, want))


def test_lines_far_apart(spark):
    """Ids whose places would meet in 64 bits, and lines beyond 2^20 of one row."""
    same = "one line of six words here"
    rows = [(0, same), (1 << 44, same), (2, "other words stand in this line"), (2 + (1 << 44), "other words stood in this line"), (-(1 << 63), "the least id"), ((1 << 63) - 1, "The least  ID")]
    got = {r["doc_id"]: r["lines_out"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 1, 1 << 44: 0, 2: 1, 2 + (1 << 44): 0, -(1 << 63): 1, (1 << 63) - 1: 0}
    df = spark.createDataFrame([(0, "\n" * (1 << 20) + same), (1, same)], "doc_id long, text string")
    assert {r["doc_id"]: r["lines_out"] for r in line_dedup.dedup_lines(df).collect()} == {0: (1 << 20) + 1, 1: 0}


def test_one_edit():
    a = [b"a", b"b", b"c", b"d"]
    for b, near in (("a b c d", False), ("a b x d", True), ("a c d", True), ("a b c d e", True), ("x a b c d", True), ("b a c d", False), ("a b", False), ("x b c y", False)):
        assert line_dedup.one_edit(a, b.encode().split()) is near and line_dedup.one_edit(b.encode().split(), a) is near


def test_lines_with_clashing_columns(spark):
    names = "row i none gone g c line halves text_ __row __i lines_in".split()
    df = spark.createDataFrame([(1, "one line of five words", *range(12)), (2, "one line of five words", *range(12))], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [r["lines_out"] for r in got] == [1, 0] and all(r[n] == k for r in got for k, n in enumerate(names[:-1]))


def test_lines_long_and_none(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    df = spark.createDataFrame([(1, long), (2, long.replace("w29990 ", "")), (3, long.replace("w15000", "other")), (4, long.replace("w1 ", "x ").replace("w2 ", "y "))], "doc_id long, text string")
    assert [r["lines_out"] for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()] == [1, 0, 0, 1]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# --- benchmark items ------------------------------------------------------------------------------


def test_leaks(spark):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    given = [(r["item_id"], r["text"]) for r in items.collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    r = random.Random(3)
    filler = " ".join("".join(r.choices("pqrst", k=5)) for _ in range(500))
    planted = [(10_000 + k, f"{filler[: r.randint(0, 2000)]} {t} {filler[2000:]}") for k, (_, t) in enumerate(given)]
    planted += [(20_000 + k, t.upper().replace("\n", " ")) for k, (_, t) in enumerate(given) if t.isascii()]
    planted += [(30_000, None), (30_001, ""), (30_002, given[0][1][: len(given[0][1]) // 3])]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(every, items).collect()}
    squeeze = lambda t: " " + " ".join(re.findall(r"[^\W_]+", lower(t or ""))) + " "
    want = {(x["doc_id"], i) for x in every.collect() for i, t in given if squeeze(t) in squeeze(x["text"])}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}
    clean = {x["doc_id"] for x in decontaminate.drop_contaminated(every, items).collect()}
    assert clean == {x["doc_id"] for x in every.collect()} - {d for d, _ in want}


def test_leak_search_like_full_scores():
    r = random.Random(8)
    index = decontaminate.Index.build([(k, " ".join(r.choices([f"w{j}" for j in range(60)], k=r.randint(5, 40)))) for k in range(150)])
    for _ in range(60):
        terms = sorted(r.sample(range(len(index.terms)), r.randint(1, 40)))
        scores = defaultdict(float)
        for t in terms:
            for i, w in zip(*index.postings[t][:2], strict=True):
                scores[i] += w
        for threshold in (0.2, 0.5, 0.8):
            assert sorted(i for i, _ in index.search(terms, threshold)) == sorted(i for i, s in scores.items() if s >= threshold - 1e-9)


def test_leaks_in_parts(spark, monkeypatch):
    """However the items are dealt to indexes, pairs and scores are the same."""
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = items.union(items.limit(5)).union(spark.createDataFrame([(900, None), (901, ""), (None, "a b c d e f"), (902, "w " * 400)], items.schema))
    r = random.Random(5)
    docs = spark.createDataFrame([(k, noisy(r, x["text"], r.randint(0, 3)) if x["text"] else x["text"]) for k, x in enumerate(items.collect())], "doc_id long, text string")
    found = lambda: sorted((x["doc_id"], str(x["item_id"]), round(x["score"], 9), x["question_overlap"], x["answer_overlap"]) for x in decontaminate.contaminated(docs, items).collect())
    kept = lambda: sorted(x["doc_id"] for x in decontaminate.drop_contaminated(docs, items).collect())
    one, clean = found(), kept()
    for name, bound in (("ITEMS", 7), ("ITEM_BYTES", 2000), ("PAIRS", 1)):
        with monkeypatch.context() as m:
            m.setattr(decontaminate, name, bound)
            if name != "PAIRS":
                assert len(decontaminate.built(items, Scratch(spark, "t"))) > 2
            assert found() == one and kept() == clean and len(one) > 30 and 0 < len(clean) < 15
    none = spark.createDataFrame([], items.schema)
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.drop_contaminated(docs, none).count() == docs.count()


@pytest.mark.parametrize(("share", "least"), [(0, 1.0), (0.02, 0.95), (0.05, 0.9), (0.1, 0.8)])
def test_leaks_with_edits(spark, share, least):
    """Recall of items planted in filler with a share of their words replaced, over three seeds; no text holds another item."""
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    given = [(x["item_id"], x["text"]) for x in items.collect()]
    rows, want = [], set()
    for seed in range(3):
        r = random.Random(seed)
        for item, text in given:
            words = text.split(" ")
            changed = [w if r.random() >= share else "".join(r.choices("pqrst", k=4)) for w in words]
            fill = [" ".join("".join(r.choices("pqrst", k=5)) for _ in range(r.randint(0, 300))) for _ in range(2)]
            want.add((len(rows), item))
            rows.append((len(rows), f"{fill[0]} {' '.join(changed)} {fill[1]}"))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert len(got & want) >= least * len(want), len(got & want) / len(want)
    clean = spark.createDataFrame([(k, " ".join(w for w, keep in ((w, r.random() < 0.5) for w in t.split()) if keep)) for k, (_, t) in enumerate(given) if len(t.split()) > 20], "doc_id long, text string")
    assert decontaminate.contaminated(clean, items).count() == 0


def test_in_order():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.in_order(np.array(a, np.uint64), np.array(b, np.uint64)) == best[-1][-1]


def test_item_parts():
    assert decontaminate.split_item("a b.\nc d\ne") == ("a b.\nc d", "e")
    assert decontaminate.split_item("One two. Three four?") == ("One two.", "Three four?")
    assert decontaminate.split_item("a b c d e f g h") == ("a b c d e f", "g h")


# --- URLs -----------------------------------------------------------------------------------------


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = lower(host)
    best = None
    for verdict, rule in queries.URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme/x", "http://example.org/es/1", "HTTP://WWW.Example.ORG/es/", "https://example.org/en/12?q=/es/", "http://org/", "http://org", "http://.org/x", "http://a.com/de/x#y", "http://com/fr/", "http://xcom/fr/", "ftp://b.co.com/FR/", "http://notexample.org/es/", "http://example.org?x=/es/", "http://a://b.org/x", "http://é.org/es/", "x://\n.org/\n"]
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(3, urls[3], "h", "p")], "page_id long, url string, host string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark, df, queries.URL_RULES).collect())
    assert got == sorted((k, *plain_rule(u)) for k, u in [*enumerate(urls), (3, urls[3])])
    assert url_filter.filter_urls(spark, df.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(spark, df, []).collect()} == {"allow"}


def test_urls_within_urls(spark):
    """The path is the outer URL's, also where that has none."""
    urls = ["https://shop.example.org?next=https://x.com/es/1", "https://shop.example.org?next=https://x.example.org/es/1", "http://a.com#http://b/de/x", "http://a.com/fr/?u=http://b.com/de/", "http://example.org://x/es/", "://://org/es/", "http://é.com?ü://b.com/de/x", "x" * 20000 + "://a.com?y://b.com/de/", "x" * 20000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark, df, queries.URL_RULES).collect())
    assert got == [(k, *plain_rule(u)) for k, u in enumerate(urls)]


def test_cascade_is_exact(spark):
    r = random.Random(12)
    universe = [f"h{k}.example/{r.randint(0, 99)}" for k in range(3000)]
    listed = set(r.sample(universe, 200))
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filter.Cascade(Scratch(spark, "t"), "c", frame(sorted(listed)), frame(universe), len(universe))
    assert len(cascade.levels) > 1
    got = {x["key"] for x in cascade.beside(frame(universe)).where(cascade.holds(F.col("key"))).collect()}
    assert got == listed
    assert all(bits <= url_filter.MAX_BITS and parts == 1 for bits, parts in cascade.levels)


def test_cascade_of_many_filters(spark, monkeypatch):
    """A list beyond one filter's bound is dealt over several, as many as it needs."""
    monkeypatch.setattr(url_filter, "MAX_BITS", 1 << 9)
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    keys = [f"h{k}.example/" for k in range(2000)]
    for n, parts in ((150, 2), (1500, 8)):
        cascade = url_filter.Cascade(Scratch(spark, "t"), "c", frame(keys[:n]), frame(keys), len(keys))
        assert cascade.levels[0][0] == 1 << 9 and cascade.levels[0][1] >= parts
        assert {x["key"] for x in cascade.beside(frame(keys)).where(cascade.holds(F.col("key"))).collect()} == set(keys[:n])


def test_long_list_of_urls(spark):
    """Two million listed keys: filters of some ten megabits, shipped as one row a level."""
    n = 2_000_000
    rules = spark.range(n).selectExpr("if(id % 2 = 0, 'block', 'allow') verdict", "concat('h', id, '.example/') rule")
    pages = spark.range(0, 2 * n, 1000).selectExpr("id page_id", "concat('https://www.H', id, '.example/a?b') url")
    out = url_filter.filter_urls(spark, pages, rules, default="none").groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in out} == {"block": 2000, "none": 2000}
    found = url_filter.filter_urls(spark, pages.selectExpr("page_id + 1 as page_id", "concat('https://h', page_id + 1, '.example/') url"), rules, default="none")
    assert {r["verdict"]: r["count"] for r in found.groupBy("verdict").count().collect()} == {"allow": 2000, "none": 2000}


# --- archives -------------------------------------------------------------------------------------


def test_archive(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    extra = [(1000, "http://A.b.c/x y", "<p>z</p>"), (1001, None, "<p>z</p>"), (1002, "http://A.b.c/x y", None), (1003, "", ""), (-5, "http://q", "<p>z</p>"), (1001, None, "<p>z</p>"), (1004, "http://q/\n", "é" * 9)]
    every = pages.union(spark.createDataFrame(extra, pages.schema))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.write_and_read(every).collect()]
    by, want = defaultdict(list), []
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in every.collect()]
    for k, p in rows:
        by[p].append(k)
    for k, p in rows:
        top = max(by[p])
        want.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if k == top else "revisit", None if k == top else top))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.write_and_read(every.limit(0)).count() == 0


def test_archive_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    archive = warc.Archive(Scratch(spark, "t"))
    archive.write(pages, revisit_from=10**9)
    keyed = pages.select("html", warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    some = keyed.limit(5)
    found = {r["key"]: r for r in archive.captures(some.select("key").union(spark.createDataFrame([("zz) 1",), ("",)], "key string"))).collect()}
    assert {k: r["payload"].decode() for k, r in found.items()} == {r["key"]: r["html"] for r in some.collect()}
    assert {r["record_type"] for r in found.values()} == {"response"}


def test_record_round_trip():
    raw = warc.record(3, "http://a/\r\nb", b"x\r\n\r\ny", "D", None, "2024-01-01T00:00:00Z")
    headers, payload = warc.parse_record(raw)
    assert payload == b"x\r\n\r\ny" and headers["warc-target-uri"] == "http://a/%0D%0Ab" and headers["warc-record-id"] == "<urn:page:3>"
    headers, payload = warc.parse_record(warc.record(3, None, b"xyz", "D", 4, "d"))
    assert headers["warc-type"] == "revisit" and headers["warc-refers-to"] == "<urn:page:4>" and payload == b""
