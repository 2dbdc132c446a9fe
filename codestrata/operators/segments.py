"""Term statistics and an inverted index that follow changes of documents: segments, tombstones, signed deltas.

A change of documents (new texts, ids that go) is one small segment:

- ``forward``: each document's size and terms with their frequencies, in the documents' order;
- ``postings``: the same by term, clustered by term;
- ``gone``: the ids whose rows in earlier segments are dead;
- ``df``: by how much each term's document frequency changed;
- ``totals``: by how much the number of documents and of tokens changed, one row.

What a document said before is found in ``forward`` by its id (a join with the
changed ids alone), so a change reads neither texts nor rows of documents that
stay as they are. Reading adds up deltas and passes over dead rows. Segments of
like size are merged, newest first, always neighbours, so that there are a few
for each power of ``FANOUT``; a merge drops dead rows. A manifest names the
segments and is switched at once.

Vectors follow in the same way (``term_vectors``): what is kept of a document is
its frequencies of the vocabulary's terms, which change only with its own text or
when a term enters or leaves the vocabulary; weights (idf, length) are applied on
reading, since they change with every document that comes or goes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import retrieval
from codestrata.operators.store import Manifests

FANOUT = 4
#: Segments up to so many documents count as equally small.
SMALL = 1000
SCHEMAS = {
    "forward": "id string, size long, terms array<struct<term:string,tf:long>>",
    "postings": "term string, id string, tf long",
    "gone": "id string",
    "df": "term string, delta long",
    "totals": "docs long, tokens long",
}
_CLUSTERED = {"postings": "term", "gone": "id", "df": "term"}
#: Up to so many changed ids are sent to the rows that they are looked up in; for more, both sides are shuffled.
FEW_IDS = 1_000_000


class TermIndex:
    """The segments below one folder. ``tokens``: what a text's terms are, repeats included."""

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = X.index_tokens):
        self.spark, self.path, self.tokens = spark, path.rstrip("/"), tokens
        self.manifests = Manifests(spark, self.path)

    # Segments.

    def segments(self) -> list[dict]:
        """Oldest first: name, number and documents of each."""
        return self.manifests.current().get("segments", [])

    def _read(self, table: str, segments: list[dict]) -> DataFrame:
        """The table's rows in these segments with ``segment``: the number of theirs."""
        parts = [self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{s['name']}/{table}").withColumn("segment", F.lit(s["number"])) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMAS[table] + ", segment int")

    def _live(self, table: str, segments: list[dict], only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The rows of documents that no later one of these segments has replaced or dropped. ``only`` comes first: what it filters reaches the scans."""
        rows = only(self._read(table, segments))
        dead = self._read("gone", segments).groupBy("id").agg(F.max("segment").alias("dead"))
        return rows.join(dead, "id", "left").where(F.col("dead").isNull() | (F.col("segment") >= F.col("dead"))).select(*[c for c in rows.columns if c != "segment"])

    def _write(self, tables: dict[str, DataFrame], name: str | None = None) -> str:
        name = name or f"segment-{uuid.uuid4().hex}"
        for table, rows in tables.items():
            by = _CLUSTERED.get(table)
            (rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows.coalesce(1) if table == "totals" else rows).write.parquet(f"{self.path}/{name}/{table}")
        return name

    # Changes.

    def _forward(self, docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(id, size, terms) of (id, text): one row an id, the greatest text of several. Terms are counted in the text's row; only texts of repeated ids are shuffled."""
        rows = docs.select(F.col("id").cast("string").alias("id"), "text")
        twice = keep(rows.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
        if not twice.isEmpty():
            same = F.col("id").eqNullSafe(F.col("_id"))
            rows = rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").groupBy("id").agg(F.max("text").alias("text")))
        tokens = rows.select("id", F.coalesce(self.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
        return tokens.select("id", F.size("tokens").cast("long").alias("size"), X.counted(F.col("tokens")).alias("terms"))

    def rebuild(self, docs: DataFrame) -> None:
        """The index of these documents (id, text) and no others."""
        self.change(docs, segments=[])

    def change(self, docs: DataFrame, gone: DataFrame | None = None, segments: list[dict] | None = None) -> None:
        """Documents (id, text) come or take the place of those with their ids; those with the ids ``gone`` (id) go. ``segments``: what the change is to, all by default."""
        segments = self.segments() if segments is None else segments
        number = segments[-1]["number"] + 1 if segments else 0
        folder = f"{self.path}/staged-{uuid.uuid4().hex}"
        keep = self._keeper(folder)
        new = self._forward(docs, keep)
        name = self._write({"forward": new})
        new = self.spark.read.schema(SCHEMAS["forward"]).parquet(f"{self.path}/{name}/forward")
        touched = new.select("id")
        if gone is not None:
            touched = touched.union(gone.select(F.col("id").cast("string"))).distinct()
        if segments:
            touched = _few(keep(touched))
            old = keep(self._live("forward", segments, lambda rows: rows.join(touched, "id", "left_semi")))
        else:
            old = self.spark.createDataFrame([], SCHEMAS["forward"])
        signed = lambda rows, sign: rows.select(F.explode("terms").alias("t")).select("t.term", F.lit(sign).alias("delta"))
        total = lambda rows: rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
        after, before = total(new), total(old).toDF("docs_before", "tokens_before")
        self._write({
            "postings": new.select("id", F.explode("terms").alias("t")).select("t.term", "id", "t.tf"),
            "gone": old.select("id"),
            "df": signed(new, 1).unionByName(signed(old, -1)).groupBy("term").agg(F.sum("delta").cast("long").alias("delta")).where("delta <> 0"),
            "totals": after.crossJoin(before).select((F.col("docs") - F.col("docs_before")).alias("docs"), (F.col("tokens") - F.col("tokens_before")).alias("tokens")),  # one row each
        }, name)
        self.manifests.commit({"segments": [*segments, {"name": name, "number": number, "docs": new.count() + old.count()}]})
        self.manifests.delete(folder)
        self.manifests.retire(lambda made: {s["name"] for s in made["segments"]})

    def _keeper(self, folder: str) -> Callable[[DataFrame], DataFrame]:
        def keep(df: DataFrame) -> DataFrame:
            place = f"{folder}/{uuid.uuid4().hex}"
            df.write.parquet(place)
            return self.spark.read.schema(df.schema).parquet(place)

        return keep

    def merge(self) -> int:
        """Merges the newest segments while ``FANOUT`` of them have one size (and with them the smaller ones between); returns how many segments there are."""
        while True:
            segments = self.segments()
            tiers = [int(math.log(max(s["docs"], SMALL) / SMALL, FANOUT) + 1e-9) for s in segments]
            run = 0
            for tier in sorted(set(tiers)):
                trailing = next((k for k, t in enumerate(reversed(tiers)) if t > tier), len(tiers))
                if tiers[len(tiers) - trailing :].count(tier) >= FANOUT:
                    run = trailing
                    break
            if not run:
                return len(segments)
            older, merged = segments[:-run], segments[-run:]
            live = self._live("forward", merged)
            # A tombstone stays while an older segment may hold what it ends.
            gone = self._read("gone", merged).select("id").distinct() if older else self.spark.createDataFrame([], SCHEMAS["gone"])
            name = self._write({
                "forward": live,
                "postings": self._live("postings", merged),
                "gone": gone,
                "df": self._read("df", merged).groupBy("term").agg(F.sum("delta").alias("delta")).where("delta <> 0"),
                "totals": self._read("totals", merged).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")),
            })
            docs = self.spark.read.schema(SCHEMAS["forward"]).parquet(f"{self.path}/{name}/forward").count()
            self.manifests.commit({"segments": [*older, {"name": name, "number": merged[-1]["number"], "docs": docs}]})
            self.manifests.retire(lambda made: {s["name"] for s in made["segments"]})

    # Reading.

    def document_frequencies(self) -> DataFrame:
        """(term, df): the deltas' sums."""
        return self._read("df", self.segments()).groupBy("term").agg(F.sum("delta").alias("df")).where("df > 0")

    def totals(self) -> DataFrame:
        """One row: the number of documents and of their tokens."""
        return self._read("totals", self.segments()).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))

    def postings(self, prefixes: list[str] | None = None) -> DataFrame:
        """(term, id, tf) of living documents; only terms with one of the prefixes, where given."""

        def only(rows: DataFrame) -> DataFrame:
            wanted = [F.col("term").startswith(p) for p in prefixes or []]
            return rows.where(reduce(lambda a, b: a | b, wanted, F.lit(False))) if prefixes is not None else rows

        return self._live("postings", self.segments(), only)

    def lengths(self) -> DataFrame:
        """(id, size) of living documents."""
        return self._live("forward", self.segments(), lambda rows: rows.select("id", "size", "segment"))

    def search(self, query: str) -> DataFrame:
        """(id, score): BM25 over the living documents; their number and mean length come from the deltas."""
        prefixes = retrieval.query_tokens(self.spark, query)
        corpus = self.totals().select(F.col("docs").alias("n"), (F.col("tokens") / F.greatest("docs", F.lit(1))).alias("mean"))
        return retrieval.bm25(self.postings(prefixes), self.lengths(), prefixes, corpus)

    def vocabulary(self, size: int = retrieval.DIMENSIONS) -> DataFrame:
        """(term, df, idf), as ``retrieval.vocabulary`` has it for all texts."""
        top = self.document_frequencies().orderBy(F.col("df").desc(), "term").limit(size)
        return top.crossJoin(F.broadcast(self.totals())).select("term", "df", F.log(F.col("docs") / (1 + F.col("df"))).alias("idf"))  # one row

    def term_counts(self, terms: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """(id, term, tf) of the living documents (of those ``ids``), for these terms: a bounded list, so that a row keeps no others before it is shuffled."""
        return self._counts(_words(terms), ids)

    def _counts(self, words: list[str], ids: DataFrame | None = None, since: int = 0) -> DataFrame:
        chosen = lambda rows: rows.select("id", F.filter("terms", lambda t: t["term"].isin(words)).alias("terms"), "segment")
        only = chosen if ids is None else lambda rows: chosen(rows.join(ids, "id", "left_semi"))
        return self._live("forward", [s for s in self.segments() if s["number"] >= since], only).select("id", F.explode("terms").alias("t")).select("id", "t.term", "t.tf")


def _few(ids: DataFrame) -> DataFrame:
    """These ids, sent to all tasks of a join where they are few."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids  # bounded


def _words(vocab: DataFrame) -> list[str]:
    return [r["term"] for r in vocab.select("term").collect()]  # at most the vocabulary's fixed size


def update_term_vectors(vectors: DataFrame, index: TermIndex, before: DataFrame, changed: DataFrame, now: DataFrame | None = None, since: int = 0) -> DataFrame:
    """``vectors`` (id, term, tf: counts of the vocabulary's terms) brought up to an index that has changed.

    ``before``: the vocabulary that they were made with, ``now``: the index's, where it is
    stored; ``changed`` (id): the documents that came, changed or went, all of them in
    segments from the number ``since`` on, so that older ones are not read for them. Rows
    of other documents stay but for terms that left the vocabulary; terms that entered
    it are looked up in the postings of those terms alone.
    """
    words, had = _words(index.vocabulary() if now is None else now), set(_words(before))
    changed = _few(changed.select(F.col("id").cast("string")).distinct())
    stay = vectors.where(F.col("term").isin(words)).join(changed, "id", "left_anti")
    out = stay.select("id", "term", "tf").unionByName(index._counts(words, changed, since))
    entered = [w for w in words if w not in had]
    if entered:
        came = index._live("postings", index.segments(), lambda rows: rows.where(F.col("term").isin(entered))).join(changed, "id", "left_anti")
        out = out.unionByName(came.select("id", "term", "tf"))
    return out


def weighted(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, w): L2-normed TF-IDF weights of counts, as ``retrieval.tfidf`` has them for texts. One shuffle; a document has at most the vocabulary's terms."""
    raw = counts.join(F.broadcast(vocab), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return raw.withColumn("norm", norm).select("id", "term", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("w"))
