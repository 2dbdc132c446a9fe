"""A training corpus from ``documents``: quality, line dedup, near-dedup, decontamination, tokens.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that
the one before kept; between stages the rows are a written Parquet table. All
stages but the last return the columns of documents.

Defined cases, in every stage: null and empty texts are documents without words
(quality gives them the score of the bias, near_dedup keeps one), null ids come last,
equal rows are treated alike, other columns pass through whatever their names, an
empty table gives no rows, and empty ``labels`` or ``benchmark`` reject nothing
(without labels every score is 0.5).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import bpe, decontaminate, line_dedup, near_copies, quality
from codestrata.llm.arrow import fresh, spread
from codestrata.llm.scratch import Scratch

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return quality.score(docs, model, score_column=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go; so do documents of which no word is left (all their lines stand elsewhere)."""
    before, after = fresh(docs, "before", "after")
    cleaned = line_dedup.dedup_lines(docs, before_column=before, after_column=after)
    left = cleaned.where((F.col(after) == F.col(before)) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) stays."""
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids."""
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

#: A linear model, an edit-distance join, a set similarity join, BM25 and BPE have no SQL form; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spread(_table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
