"""Token counts through a digest cache.

A count depends on a text's normal content and on the tokenizer alone. So counts
are stored under (digest of the normal content, digest of the tokenizer file):
a run joins its digests to the stored ones, encodes each distinct missing
content once and appends what it found. Where the tokenizer drops white space, the
normal content folds runs of space, tab, line feed and carriage return into one
space and trims them; for any other it is the text as it is. The digest is SHA-256.
Tokenizer files are those of the ``tokenizers`` library (JSON); others are refused.

Encoding. The tokenizer's pre-tokenizer never crosses white space, so a text's
count is the sum over its white-space chunks; a worker remembers the chunks it
has met in a memo of fixed size, and asks the library for the others. Texts with
characters where this shortcut needs the library's own normaliser (anything from
U+0300, control characters) or with special strings are given to the library
whole.

Defined cases: null is the empty text, of 0 bytes and 0 tokens; equal texts are
encoded once and all get their count; rows are neither merged nor dropped.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.arrow import column, map_rows
from codestrata.llm.scratch import Scratch

CHUNKS = 300_000
LONGEST = 100
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"

#: Where the whole text goes to the library: controls that its white space may or may not hold, and all beyond Latin.
_LIBRARY = regex.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u0300-\U0010ffff]")


def described(path: str) -> dict:
    """A tokenizer file's JSON."""
    try:
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
    except ValueError as e:
        made = e
    if not isinstance(made, dict) or not isinstance(made.get("model"), dict):
        raise ValueError(f"{path} is no JSON file of the tokenizers library; other kinds, like sentencepiece models, are not supported")
    return made


def drops_white_space(made: dict) -> bool:
    """Whether the count is the sum over white-space chunks: NFC, white space folded, lower case; white space removed by the splitter."""
    steps = made.get("normalizer") or {}
    kinds = [x["type"] for x in steps.get("normalizers", [])]
    split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and bool(split.get("invert")) and made["model"].get("type") == "BPE"


class Counter:
    """Counts of whole texts by a ``tokenizers`` file, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = described(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_chunk = drops_white_space(made)
        special = [x["content"] for x in made.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_chunk or _LIBRARY.search(text) or (self.special and self.special.search(text)):
            return self.whole(text)
        chunks = text.lower().split()
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, chunks))
        except KeyError:
            pass
        missing = list({c for c in chunks if c not in memo})
        if len(memo) + len(missing) > CHUNKS:
            memo.clear()
            missing = list(set(chunks))
        fresh = dict(zip(missing, (len(x.ids) for x in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)), strict=True))
        memo.update(fresh)
        total = sum(map(memo.__getitem__, chunks))
        for chunk in fresh:
            if len(chunk) > LONGEST:
                del memo[chunk]
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This process's counter for a tokenizer file."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path)
    return _counters[path]


def content_digest(text: Column, folded: bool = True) -> Column:
    """SHA-256 of the normal content, as 32 bytes; ``folded``: white space does not count."""
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")) if folded else text, 256))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class DigestCache:
    """Counts stored as a Parquet table that only grows; any number of tokenizers share it, a run reads its own's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            self._append(spark.createDataFrame([], CACHE_SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        rows.write.partitionBy("tokenizer_digest").mode("append").parquet(self.path)

    def counts(self, version: str) -> DataFrame:
        stored = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        # Two runs may append one content; its counts are equal.
        return stored.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def add(self, counts: DataFrame, version: str) -> None:
        self._append(counts.select("content_digest", F.lit(version).alias("tokenizer_digest"), F.col("n_tokens").cast("long")))


def count_tokens(docs: DataFrame, path: str, cache: DigestCache, *, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, ``n_bytes``, ``n_tokens`` and ``over_limit`` (``n_tokens > limit``).

    Shuffles: digests to the stored counts; each distinct missing content once
    (copies meet in the map-side aggregate, so a hot content is one row a task);
    digests back to their counts, which are written first, so that the join is one
    of two scans and adaptive execution splits it where one content is hot.
    """
    folded = drops_white_space(described(path))
    # Counts of folded contents that a cache may hold for such a tokenizer are not read.
    version = tokenizer_digest(path) + ("" if folded else "-raw")
    text = F.coalesce(docs[text_column], F.lit(""))
    keyed = docs.select(docs[id_column].alias("i"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text, folded).alias("content_digest"))
    contents = docs.select(content_digest(text, folded).alias("content_digest"), text.alias("t"))
    missing = contents.join(cache.counts(version), "content_digest", "left_anti").groupBy("content_digest").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield {"content_digest": column(part, "content_digest"), "n_tokens": [own.count(t) for t in column(part, "t").to_pylist()]}

    cache.add(map_rows(missing, "content_digest binary, n_tokens long", run), version)
    counts = Scratch(docs.sparkSession, "token-counts").table(cache.counts(version), "counts")
    return (
        keyed.join(counts, "content_digest", "left")
        .select("i", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
        .withColumnRenamed("i", id_column)
    )
