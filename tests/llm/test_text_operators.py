"""HTML text, BPE, token counts, quality and their edge cases, against brute force and the libraries."""

import hashlib
import math
import random
import re
import time
import zlib
from xml.etree import ElementTree

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import bpe, html_text, quality, queries, token_counts, words
from codestrata.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"
NASTY = [None, "", " ", "\n\n", "a", "don't  stop\t\n the  ", "Éa  b c 123 ١٢", "é 你好 \U0001f600", "<|endoftext|> x", "x" * 5000, "word " * 20000, "a\x00b\x1cc\x85d", "İIı ſ ǅ"]


@pytest.fixture(scope="module")
def docs(spark):
    found = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = [(k, t, "n", 1) for k, t in enumerate(NASTY + found[:60])] + [(None, "null id", "n", 1), (3, "a", "n", 1), (4, "a", "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, i int")


def encoding():
    ranks = bpe.load_ranks(public_tokenizers.path(queries.BPE_RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(docs):
    lib = encoding()
    out = bpe.encode_documents(docs, public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN).collect()
    given = docs.collect()
    assert len(out) == len(given)
    want = {}
    for r in given:
        text = r["text"] or ""
        ids = lib.encode_ordinary(text)
        want.setdefault(r["doc_id"], []).append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["token_ids"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_bpe_transducer_on_bytes():
    lib, own = encoding(), bpe.codec(public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN).transducer
    r = random.Random(5)
    tokens = list(own.ranks)
    for k in range(3000):
        piece = [bytes(r.choices(range(256), k=r.randint(1, 12))), b"".join(r.choices(tokens, k=r.randint(1, 5))), bytes(r.choices(b"abe", k=r.randint(1, 40))), bytes([r.choice(b"a =-_e")]) * r.randint(1, 300)][k % 4]
        assert own.encode(piece) == lib._core_bpe.encode_single_piece(piece)


def test_bpe_long_pieces_and_small_stores(monkeypatch):
    lib = encoding()
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "WINDOW", 64)
    own = bpe.Codec(bpe.load_ranks(public_tokenizers.path(queries.BPE_RANKS)), public_tokenizers.PATTERN)
    r = random.Random(6)
    for piece in ("ab" * 3000, "".join(r.choices("theranoi", k=5000)), "=" * 4001):
        assert own.encode(piece) == lib.encode_ordinary(piece)


def test_utf8_machine():
    r = random.Random(7)
    for _ in range(2000):
        data = bytes(r.choices([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF], k=9))
        machine, cuts = bpe.Utf8Machine(), sorted(r.choices(range(10), k=2))
        assert "".join(machine.feed(p) for p in (data[: cuts[0]], data[cuts[0] : cuts[1]], data[cuts[1] :])) + machine.close() == data.decode("utf-8", "replace")


def test_counts_like_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(queries.COUNTED_TOKENIZER))
    cache = token_counts.DigestCache(spark, Scratch(spark, "t").path("cache"))
    path = public_tokenizers.path(queries.COUNTED_TOKENIZER)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, path, cache).collect()), key=key)
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 2048))
    assert got == sorted(want, key=key)
    stored = spark.read.parquet(cache.path).count()
    again = token_counts.count_tokens(docs, path, cache)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in again.collect()), key=key) == got
    assert spark.read.parquet(cache.path).count() == stored  # nothing was encoded twice
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


def test_token_counts_of_white_space(spark, tmp_path):
    """A tokenizer that keeps white space counts each text by itself; files of another kind are refused."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, " ": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.Split(Regex(r"\s"), "isolated")
    path = str(tmp_path / "kept.json")
    own.save(path)
    texts = ["a a", "a  a", " a a", "a\na", None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cache = token_counts.DigestCache(spark, Scratch(spark, "t").path("kept"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path, cache).collect()}
    assert got == {k: len(own.encode(t or "").ids) for k, t in enumerate(texts)}
    (tmp_path / "x.model").write_bytes(b"\n\x0e\n\x05<unk>\x15\xff")
    with pytest.raises(ValueError, match="not supported"):
        token_counts.count_tokens(docs, str(tmp_path / "x.model"), cache)


def test_counts_by_chunk_cover_latin():
    own = token_counts.Counter(public_tokenizers.path(queries.COUNTED_TOKENIZER))
    for point in range(0x20, 0x300):
        text = f"a{chr(point)}1 {chr(point)}{chr(point)}x 's{chr(point)}\n"
        assert own.count(text) == own.whole(text), hex(point)


def test_html():
    text = html_text.main_text
    assert text(None) == "" and text("") == "" and text("just text") == "just text"
    assert text("<body><script>x") == "" and text("<article><p>x<p>y &am") == "x\ny &am"
    assert text("<div><p>a &lt;b&gt;&nbsp;<i>c</i>\n d</p><p>e") == "a <b> c d\ne"
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class=with-sidebar><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="ad">Buy</div><div class="cookie-notice">We use cookies, very many of them, all day and all night long</div><main><article><h1>Head</h1><p>One <a href=x>two</a>.<p>Three
    <aside>side</aside><form>f<input></form><ul><li>i<li>j</ul></article><section id="comments"><p>Reader says a lot of things here, more than the article does itself</p></section></main>
    <footer>foot</footer><script>var t="</p>"</script></body></html>"""
    assert text(page) == "Head\nOne two.\nThree\ni\nj"
    plain = "<body><div id=top><a href=a>l1</a> <a href=b>l2</a></div><div><p>" + "word " * 80 + "</p><p>" + "more " * 60 + "</p></div><div><a href=c>x</a><a href=d>y</a></div></body>"
    assert text(plain) == ("word " * 80).strip() + "\n" + ("more " * 60).strip()
    nested = '<div class="layout has-sidebar"><article><p>Body of it.</p></article><div class="comments"><article><p>A reader says a thing or two.</p></article></div></div>'
    assert text(nested) == "Body of it."
    assert text('<article><p>Short.</p></article><div class="comments"><article>Long words of a reader of this page</article></div><div class="adBox"><h1>Buy</h1></div>') == "Short."
    for opening in ("<div>", "<p><table><tr><td>", "<p><span>", "<table>", "<li><b>"):
        start = time.monotonic()
        assert text(opening * 100_000 + "deep") == "deep"
        assert time.monotonic() - start < 30, opening


def test_html_without_named_parts():
    """Tags and names alone decide nothing about running text, page-wide forms and what stands around the article."""
    text = html_text.main_text
    long = " ".join(["several words of a paragraph"] * 12)
    assert text(f"<body><form id=aspnetForm><input><div><p>{long}</p><p>{long}</p><p>End.</p></div><select><option>x</select></form></body>") == f"{long}\n{long}\nEnd."
    assert text(f'<div class=post><p>{long}</p><p class="legal">By law.</p><p>See <span class="tags">this one</span> too.</p><p>{long}</p></div>') == f"{long}\nBy law.\nSee this one too.\n{long}"
    assert text(f"<main><h1>T</h1><p>{long}</p><div class=userposts><p>{long} says a reader</p></div></main>") == f"T\n{long}"
    assert text(f'<body class="with-sidebar"><div class="page has-sidebar"><div><p>{long}</p><p>{long}</p><p>{long}</p></div><div class=sidebar><p>Read on</p></div></div>') == f"{long}\n{long}\n{long}"
    assert text(f"<article><p>{long}</p></article><article><p>{long} more</p></article><div class=ad><p>{long}</p></div>") == f"{long}\n{long} more"


def page_of(r):
    """A page of blocks without telling names."""

    def block(depth):
        words = " ".join("".join(r.choices("abcdefg", k=r.randint(1, 9))) for _ in range(r.choice([1, 3, 12, 40])))
        kind = r.random()
        if depth == 0 or kind < 0.35:
            return f"<p>{words}</p>"
        if kind < 0.5:
            return "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in words.split()[:6]) + "</ul>"
        if kind < 0.6:
            return f"<p>{words} <a href=y>{words[: r.randint(1, 20)]}</a></p>"
        return "<div>" + "".join(block(depth - 1) for _ in range(r.randint(1, 5))) + "</div>"

    return "<html><body>" + "".join(block(3) for _ in range(r.randint(1, 5))) + "</body></html>"


def plain_main_text(page):
    """The density method, read off its definition with one walk for each number."""
    tree = ElementTree.fromstring(page.replace("=x", "='x'").replace("=y", "='y'"))
    up = {c: p for p in tree.iter() for c in p}
    body = tree.find("body")
    size = lambda texts: sum(len("".join((t or "").split())) for t in texts)
    own = lambda n: size([n.text, *(c.tail for c in n)])
    chars = lambda n: size(n.itertext())
    links = lambda n: sum(chars(a) for a in n.iter("a"))

    def density(c, tags, link, link_tags):
        if not c:
            return 0.0
        base = math.log(c / max(c - link, 1) * link + links(body) / max(chars(body), 1) * c + math.e)
        inner = math.log(max(c / max(link, 1) * max(tags, 1) / max(link_tags, 1), 1))
        return c / max(tags, 1) * (inner / math.log(base) if base > 1 else inner)

    of = {n: density(chars(n), sum(1 for _ in n.iter()) - 1, links(n), sum(1 for _ in n.iter("a"))) for n in tree.iter()}
    total = {n: sum(of[c] for c in n) + density(own(n), 0, 0, 0) for n in tree.iter()}
    best = max([n for n in tree.iter() if n.tag in ("html", "body", "div") and chars(n)][::-1], key=total.get)
    path = [best]
    while path[-1] is not body and path[-1] in up:
        path.append(up[path[-1]])
    threshold = min(of[n] for n in path if n is not body or n is best)
    out = []

    def walk(n):
        if n is best or (n not in path and n.tag in ("div", "p", "ul", "li") and chars(n) and of[n] >= threshold and links(n) * 2 <= chars(n)):
            out.extend(" ".join("".join(b.itertext()).split()) for b in n.iter() if b.tag in ("p", "li"))
        else:
            for c in n:
                walk(c)

    walk(tree)
    return "\n".join(out)


def test_html_by_density(monkeypatch):
    r = random.Random(17)
    pages = [page_of(r) for _ in range(300)]
    got = [html_text.main_text(p) for p in pages]
    assert got == [plain_main_text(p) for p in pages]
    whole = sum(t == html_text.main_text("<body>" + re.sub("<a .*?</a>", "", p)) for p, t in zip(pages, got, strict=True))
    monkeypatch.setattr(html_text, "_density", lambda m, body: 1.0)
    assert whole < 280 and sum(html_text.main_text(p) != t for p, t in zip(pages, got, strict=True)) > 100


def test_html_pages(spark):
    import html as h
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    extra = spark.createDataFrame([(-1, "u", None), (-2, None, "")], pages.schema)
    out = {r["page_id"]: r for r in html_text.extract_text(pages.union(extra)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*(>|\Z)", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert out[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert out[r["page_id"]]["n_chars"] == len(out[r["page_id"]]["text"])
    assert out[-1]["text"] == "" and out[-2]["n_chars"] == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = quality.train(docs, labels)
    found = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in found)
    wrong = sum((r["score"] >= quality.THRESHOLD) != (r["quality"] == 1) for r in found)
    assert len(found) > 400 and wrong / len(found) < 0.02


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x y", 0.5), (2, "", 0.5)], "doc_id long, text string, score double")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, empty)).collect()
    assert len(out) == 4 and all(r["score"] == pytest.approx(0.5) for r in out)
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, quality.train(docs, one)).collect())
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), empty)).count() == 0


def test_dual_descent_separates():
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(50, 8, replace=False)).astype(np.int32) + (0 if k % 2 else 50) for k in range(80)]
    model = quality.fit(rows, np.arange(80) % 2)
    scores = model.scores(rows)
    assert (scores[1::2] > 0.5).all() and (scores[::2] < 0.5).all()


def test_dual_descent_like_its_definition():
    """Ratios by counting; the fit closes the gap between the primal and the dual objective."""
    r = np.random.default_rng(3)
    rows = [np.sort(r.choice(40, r.integers(1, 9), replace=False)).astype(np.int32) for _ in range(60)]
    y = np.where(r.random(60) < 0.5 + 0.4 * np.array([(x < 20).mean() - (x >= 20).mean() for x in rows]), 1, -1)
    ratio = quality.log_count_ratio(rows, y)
    count = lambda f, label: 1 + sum(f in x for x, k in zip(rows, y, strict=True) if k == label)
    total = {k: quality.SLOTS + sum(len(x) for x, j in zip(rows, y, strict=True) if j == k) for k in (1, -1)}
    for f in range(40):
        assert ratio[f] == pytest.approx(np.log(count(f, 1) / total[1] / (count(f, -1) / total[-1])))
    values = [ratio[x] / np.linalg.norm(ratio[x]) for x in rows]
    cost = np.full(60, 0.7)
    w, bias = quality.dual_descent(rows, values, y, cost, 3000)
    dense = np.zeros((60, 41))
    for k, (x, v) in enumerate(zip(rows, values, strict=True)):
        dense[k, x], dense[k, 40] = v, 1.0
    whole = np.concatenate((w[:40], [bias]))
    primal = whole @ whole / 2 + (cost * np.maximum(0, 1 - y * (dense @ whole))).sum()
    # The same problem by projected gradient on the dual, a plainer and slower way.
    q = (dense * y[:, None]) @ (dense * y[:, None]).T
    alpha = np.zeros(60)
    for _ in range(20000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    assert primal >= dual - 1e-6 and primal - dual < 0.02 * dual


def test_quality_of_repeated_ids(spark):
    """An id's rows are learnt from once, whichever order they come in."""
    docs = spark.createDataFrame([(k % 40, f"word{k % 2} more text {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] * 2, "doc_id long, quality int, toxic int")
    one, two = (quality.train(docs.repartition(n), labels) for n in (2, 5))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_words():
    texts = [b"", b" ", b"a", b"A b\t\nc ", b"  x", b"a a b a a b"]
    w = words.Words(texts)
    assert w.counts.tolist() == [0, 0, 1, 3, 1, 6] and w.data == b"a a b c x a a b a a b "
    h = w.hashes()
    assert h[0] == h[1] == h[5] and h[2] == h[7] and len(set(h.tolist())) == 4
    text, hashes = w.shingle_hashes(3)
    assert text.tolist() == [2, 3, 4, 5, 5, 5, 5] and hashes[3] == hashes[6] != hashes[4]


def test_pipeline(spark):
    """Every stage on what the one before kept, against its operator's definition in plain Python."""
    from tests.llm.test_pair_operators import split, within

    out = corpus_pipeline.run(spark, DATA)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    stages = dict(corpus_pipeline.STAGES)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in given.collect()}

    def kept(name, rows):
        found = stages[name](spark, rows, DATA)
        assert found.columns == columns, name
        return spark.createDataFrame(found.collect(), given.schema)

    # Quality: the score of each text by itself, from the model of the same labels.
    one = kept("quality", given)
    model = quality.train(given, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {k: t for k, t in docs.items() if model.scores(quality.features([(t or "").encode()]))[0] >= quality.THRESHOLD}
    assert {r["doc_id"]: r["text"] for r in one.collect()} == good and len(good) < len(docs)
    # Lines: all earlier lines, one by one.
    two = kept("line_dedup", one)
    seen, want = {}, {}
    for k in sorted(good):
        lines, left = (good[k] or "").split("\n"), []
        for line in lines:
            words = tuple(split(line))
            near = {words} | {words[:j] + words[j + 1 :] for j in range(len(words))} | {words[:j] + ("",) + words[j + 1 :] for j in range(len(words))}
            old = {x for key in near for x in seen.get(key, ())} if words else set()
            if not any(within(list(words), list(x)) for x in old):
                left.append(line)
            for key in near if words else ():
                seen.setdefault(key, set()).add(words)
        if len(left) == len(lines) or any(split(x) for x in left):
            want[k] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in two.collect()} == want and want != good
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    # Near copies: all pairs of shingle sets, components, the least id stays.
    three = kept("near_dedup", two)
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := split(t)) else set() for k, t in want.items()}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if b < a and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {k: low if x == high else x for k, x in root.items()}
    assert {r["doc_id"] for r in three.collect()} == set(root.values())
    # Benchmark items: no text keeps one whole, and only texts with most of one's words go.
    four = kept("decontamination", three)
    items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = {k: " ".join(re.findall(r"[^\W_]+", (want[k] or "").lower())) for k in set(root.values())}
    left = {r["doc_id"] for r in four.collect()}
    assert not any(f" {i} " in f" {plain[k]} " for k in left for i in items)
    assert all(max(len(set(i.split()) & set(plain[k].split())) / len(set(i.split())) for i in items) > 0.7 for k in set(plain) - left)
    # Tokens, and the whole run.
    lib = encoding()
    assert {r["doc_id"]: r["token_ids"] for r in out.collect()} == {k: lib.encode_ordinary(want[k] or "") for k in left}


# --- pages without helpful names ------------------------------------------------------------------


def _paragraph(n):
    return "<p>" + " ".join(f"Sentence number {n} tells of things that happened, at some length, and without hurry." for _ in range(3)) + "</p>"


def _starts(page):
    return [line[:17] for line in html_text.main_text(page).split("\n")]


def test_main_element_around_an_article():
    links = "<div>" + "".join(f'<a href="/{k}">Another story number {k}</a> ' for k in range(8)) + "</div>"
    voices = "<div><div>Bob says: nice one</div><div>Ann says: I agree with that</div></div>"
    page = f"<body><main><h1>Head</h1><article>{_paragraph(1)}{_paragraph(2)}{links}{_paragraph(3)}</article>{links}{voices}</main></body>"
    assert _starts(page) == ["Head", "Sentence number 1", "Sentence number 2", "Sentence number 3"]


def test_names_that_only_sound_like_asides():
    inner = f"<div class='legal-analysis'>{_paragraph(2)}</div><section class='related-work'>{_paragraph(3)}</section><section id='search-methods'>{_paragraph(4)}</section>"
    beside = f"<div class='comment-list'>{_paragraph(5)}</div><div class='ad-slot-2'>{_paragraph(6)}</div><div id='socialShare'>{_paragraph(7)}</div>"
    assert _starts(f"<body><article><h1>Head</h1>{_paragraph(1)}{inner}{beside}</article></body>") == ["Head", *(f"Sentence number {n}" for n in (1, 2, 3, 4))]


def test_two_articles():
    page = f"<body><article><h2>One</h2>{_paragraph(1)}{_paragraph(2)}{_paragraph(3)}</article><article><h2>Two</h2><p>Short <b>one</b> here with <i>marks</i>.</p>{_paragraph(4)}</article><article><p>Nice one!</p></article></body>"
    assert _starts(page) == ["One", *(f"Sentence number {n}" for n in (1, 2, 3)), "Two", "Short one here wi", "Sentence number 4"]


def test_many_siblings():
    page = "<body><div>" + "<span class=a>x y</span>" * 100_000 + "</div></body>"
    begun = time.monotonic()
    assert html_text.main_text(page).startswith("x y") and time.monotonic() - begun < 60
