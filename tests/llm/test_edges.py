"""Every stage and operator on awkward tables: nulls everywhere, repeated rows, clashing columns, no rows."""

from datetime import datetime

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import decontaminate, html_text, line_dedup, minhash, queries, quality, simhash, token_counts, url_filter, warc
from codestrata.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i string, t int, row string, fp double, key binary, part array<int>, line map<string,int>, score string, lines_in long, h timestamp, parent_class struct<a:int,b:string>, __row long, __i string, __none int, __n int, none int, n int, gone int, clean int, before int, after int, best int, digest binary"


@pytest.fixture(scope="module")
def awkward(spark):
    more = ("i", 1, "row", 0.5, b"k", [1, None], {"a": 1}, "s", 7, datetime(2024, 1, 1), (1, "b"), 8, "own", *range(9), b"d")
    none = (None,) * 23
    long = "one long line " * 30000
    rows = [(1, "The first line here.\nAnother line of it, not short.", "en", "s", 5, *more), (1, "The first line here.\nAnother line of it, not short.", "en", "s", 5, *more), (2, None, None, None, None, *none), (None, None, None, None, None, *none), (None, "", "", "", 0, *none), (3, "", "en", "s", 0, *more), (4, long, "en", "s", len(long), *more), (5, "\n\n \n", "en", "s", 4, *none), (5, "é" * 70, "fr", "s", 70, *none)]
    return spark.createDataFrame(rows, SCHEMA)


def with_tables(spark, path, empty):
    for name in ("labels", "benchmark"):
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        nulls = spark.createDataFrame([(None,) * len(df.columns)], df.schema)
        (df.limit(0) if empty else df.union(nulls).union(df.limit(3))).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, awkward, tmp_path, name, empty):
    stage, d = dict(corpus_pipeline.STAGES)[name], with_tables(spark, tmp_path / "d", empty)
    for docs in (awkward, awkward.limit(0)):
        out = stage(spark, docs, d)
        rows = out.collect()
        assert len(rows) <= docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if docs is awkward:
            kept = [r for r in rows if r["doc_id"] == 1]
            assert kept
            if "part" in out.columns:
                assert kept[0]["part"] == [1, None] and kept[0]["h"] == datetime(2024, 1, 1) and kept[0]["parent_class"]["b"] == "b" and kept[0]["lines_in"] == 7
                assert kept[0]["__row"] == 8 and kept[0]["__i"] == "own" and [kept[0][c] for c in "__none __n none n gone clean before after best".split()] == list(range(9))


def test_operators(spark, awkward):
    n = awkward.count()
    model = quality.train(awkward, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert quality.score(awkward, model).count() == n
    assert line_dedup.dedup_lines(awkward).count() == n
    assert simhash.near_duplicates(awkward).count() == n and minhash.fingerprint_documents(awkward).count() == n
    cache = token_counts.DigestCache(spark, Scratch(spark, "e").path("c"))
    assert token_counts.count_tokens(awkward, public_tokenizers.path(queries.COUNTED_TOKENIZER), cache).count() == n
    assert decontaminate.contaminated(awkward, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    pages = awkward.withColumn("page_id", F.col("doc_id")).withColumn("url", F.lit("http://a.org/x")).withColumn("html", F.col("text")).withColumn("path", F.lit(1))
    assert html_text.extract_text(pages, text_column="main").count() == n
    assert url_filter.filter_urls(spark, pages, queries.URL_RULES).where("verdict = 'allow' and rule = 'org/'").count() == n
    assert warc.write_and_read(pages).count() == n
