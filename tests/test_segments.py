"""The index that follows changes: after each, what it says is what a full build of the living documents says."""

import os
import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import retrieval, segments

WORDS = "alpha beta gamma delta erthe anon naïve Éclair x1 snake_case".split()


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def followed(spark, tmp_path_factory):
    """An index after six random changes, and the documents then; the vectors' counts, followed too."""
    r = random.Random(5)
    living, path = {}, tmp_path_factory.mktemp("segments")
    index = segments.TermIndex(spark, f"file://{path}/index", X.tfidf_tokens)
    counts = vocab = None
    for step in range(6):
        new = {str(r.randrange(30)): " ".join(r.choices(WORDS, k=r.randint(0, 8))) if r.random() < 0.9 else None for _ in range(40 if step == 0 else r.randint(0, 5))}
        gone = {str(r.randrange(35)) for _ in range(r.randint(0, 4))} - set(new) if step else set()
        index.change(spark.createDataFrame(list(new.items()), "id string, text string"), spark.createDataFrame([(g,) for g in gone], "id string"))
        living = {k: v for k, v in {**living, **new}.items() if k not in gone}
        now = index.vocabulary(6)
        if counts is None:
            counts = index.term_counts(now)
        else:
            index_vocabulary, index.vocabulary = index.vocabulary, lambda: index_vocabulary(6)
            counts = segments.update_term_vectors(counts, index, vocab, spark.createDataFrame([(k,) for k in {*new, *gone}], "id string"))
            del index.vocabulary
        for name, df in (("counts", counts), ("vocab", now)):
            df.write.parquet(f"file://{path}/{name}-{step}")
        counts, vocab = (spark.read.parquet(f"file://{path}/{name}-{step}") for name in ("counts", "vocab"))
    return index, spark.createDataFrame(list(living.items()), "id string, text string"), counts, path


def same_as_rebuilt(index, docs):
    tokens = X.tfidf_tokens
    postings, lengths = retrieval.inverted_index(docs, "id", ["text"], tokens)
    assert rows(index.postings()) == rows(postings)
    assert rows(index.lengths()) == rows(lengths)
    assert rows(index.document_frequencies()) == rows(postings.groupBy("term").count())
    assert rows(index.totals()) == rows(lengths.agg(F.count("*"), F.sum("size")))
    assert rows(index.search("anon del")) == rows(retrieval.bm25(postings, lengths, ["anon", "del"]))


def test_index_follows_changes(followed):
    index, docs, _, _ = followed
    assert len(index.segments()) == 6
    same_as_rebuilt(index, docs)


def test_vectors_follow_changes(followed):
    index, docs, counts, _ = followed
    vocab = retrieval.vocabulary(docs, "id", "text", 6)
    assert rows(index.vocabulary(6)) == rows(vocab)
    assert rows(segments.weighted(counts, index.vocabulary(6))) == rows(retrieval.tfidf(docs, vocab, "id", "text"))


def test_merging_keeps_what_lives(spark, followed):
    index, docs, _, path = followed
    assert index.merge() == 1
    same_as_rebuilt(index, docs)
    merged = index.segments()
    assert index._read("gone", merged).count() == 0 and index._read("forward", merged).count() == docs.count()  # dead rows are gone
    big = f"{path}/index/{merged[0]['name']}"
    index.change(spark.createDataFrame([("0", "gamma gamma")], "id string, text string"))
    small = f"{path}/index/{index.segments()[-1]['name']}"
    size = lambda p: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(p) for f in fs if f.startswith("part"))
    assert index._read("postings", index.segments()[-1:]).count() == 1 and size(small) < size(big)
    same_as_rebuilt(index, docs.where("id <> '0'").unionByName(spark.createDataFrame([("0", "gamma gamma")], "id string, text string")))


def test_empty_index(spark, tmp_path):
    index = segments.TermIndex(spark, f"file://{tmp_path}/none")
    assert index.search("anon").count() == 0 and index.document_frequencies().count() == 0 and index.merge() == 0
    index.change(spark.createDataFrame([], "id string, text string"))
    assert rows(index.totals()) == [(0, 0)]
