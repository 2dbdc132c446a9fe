"""One project's graph: built from its tree, kept in a store, asked through plain dicts.

This is the edge of the library: what is collected here is one answer for one
caller, of a bounded size; everything below is lazy tables.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import cost, extract, graph, impact, incremental, retrieval, segments, substrings, syntax
from codestrata.operators.store import Replaced, Store, clear_files, rename_files
from codestrata.sources import trees


def rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def first(df: DataFrame) -> dict[str, Any]:
    row: Row | None = df.first()
    return row.asDict(recursive=True) if row else {}


def _indexed(nodes: DataFrame) -> DataFrame:
    """(id, text): what the term index holds of a node."""
    return nodes.select("id", F.concat_ws(" ", *retrieval.INDEXED).alias("text"))


class Project:
    """``root``: the source tree; ``path``: the store's folder, by default inside the tree."""

    def __init__(self, spark: SparkSession, root: str, path: str | None = None, scorer=None, encoder: retrieval.Encoder | None = None):
        self.spark, self.root, self.scorer, self.encoder = spark, root, scorer, encoder
        self.store = Store(spark, path or f"{root.rstrip('/')}/.codestrata/tables")
        self.terms = segments.TermIndex(spark, f"{self.store.path}/terms")

    # Tables.

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        """The edges as they were found: calls point to names."""
        return self.store.read("edges")

    @property
    def resolved(self) -> DataFrame:
        """The edges with an edge to each node that a call's name stands for, each with an id of its own."""
        found = extract.expand(self.edges, self.store.read("names"))
        return found.withColumn("id", F.when(F.col("to_id") != "", F.xxhash64("id", "to_id")).otherwise(F.col("id")))

    @property
    def index(self) -> tuple[DataFrame, DataFrame]:
        """The stored postings, clustered by term, and lengths."""
        return self.terms.postings(), self.terms.lengths()

    @property
    def runs(self) -> tuple[DataFrame, DataFrame]:
        """The stored runs of characters, clustered by run, and how often each stands."""
        return self.store.read("runs"), self.store.read("run_counts")

    def total_files(self) -> DataFrame:
        return self.nodes.agg(F.count_distinct("file").alias("total_files"))

    # Building.

    def build(self) -> dict[str, Any]:
        """Parses the tree, embeds and writes all tables in one switch; returns the statistics."""
        with self.store.staged() as keep:
            nodes, edges = syntax.parse_best(trees.read_sources(self.spark, self.root), trees.languages_in(self.spark, self.root), keep)
            self._write(keep(nodes), keep(extract.numbered(edges)), trees.scan_hashes(self.spark, self.root), keep)
        self.terms.rebuild(_indexed(self.nodes))
        return self.stats()

    def _write(self, nodes: DataFrame, edges: DataFrame, hashes: DataFrame, keep: Callable[[DataFrame], DataFrame], before: DataFrame | None = None, change: tuple[Replaced, Replaced] | None = None) -> None:
        """All tables that follow from these nodes, edges and files, switched to at once.

        ``before``: embeddings whose texts may have stayed; ``change``: what became of the stored nodes and edges, where they are not all new.
        """
        new_nodes, new_edges = change or (nodes, edges)
        vectors, vocab = retrieval.embed_nodes(nodes, graph.context(nodes, edges), encoder=self.encoder, before=before)
        runs = keep(substrings.build(nodes, "id", retrieval.LIKE_COLUMNS))
        counts = nodes.groupBy("file").agg(F.count("*").cast("int").alias("node_count"))
        self.store.write_all({
            "nodes": (new_nodes, "file"),
            "edges": (new_edges, "to_name"),
            "names": (extract.names_of(nodes), "name"),
            "vocabulary": (keep(vocab), None),
            "embeddings": (vectors, None),
            "runs": (runs, "run"),
            "run_counts": (substrings.counts(runs), "run"),
            "file_hashes": (hashes.join(counts, "file", "left").select("file", "sha256", F.coalesce("node_count", F.lit(0)).alias("node_count")), None),
        })

    def update(self) -> dict[str, int]:
        """Brings the tables up to the tree: what changed is parsed again, what was moved is renamed, what went is cleared.

        One switch of all tables; then the term index gets a segment of the
        nodes whose text or file changed. A search in between may find nodes that
        are gone, which its join with the nodes drops.
        """
        with self.store.staged() as keep:
            now = keep(trees.scan_hashes(self.spark, self.root))
            before = self.store.read("file_hashes")
            found = keep(incremental.snapshot_diff(before.select("file", "sha256"), now))
            moves = keep(incremental.moved(found, before, now))
            changed = keep(found.where("change = 'changed'").join(moves, F.col("file") == F.col("new"), "left_anti").select("file"))
            deleted = keep(found.where("change = 'deleted'").join(moves, F.col("file") == F.col("old"), "left_anti").select("file"))
            counts = {"changed": changed.count(), "deleted": deleted.count(), "renamed": moves.count()}
            if not any(counts.values()):
                return counts
            gone = keep(changed.union(deleted).union(moves.select("old")))
            sources = trees.read_sources(self.spark, self.root).join(changed, "file", "left_semi")
            parsed = extract.parse(sources)
            moved = [rename_files(t.join(moves.select(F.col("old").alias("file")), "file", "left_semi").select(*t.columns), moves) for t in (self.nodes, self.edges)]
            new_nodes = keep(moved[0].unionByName(parsed[0].select(*self.nodes.columns)))
            new_edges = keep(moved[1].unionByName(extract.numbered(parsed[1]).select(*self.edges.columns)))
            old = keep(self.nodes.join(gone, "file", "left_semi").select("id"))
            nodes, edges = (keep(clear_files(t, gone).unionByName(new)) for t, new in ((self.nodes, new_nodes), (self.edges, new_edges)))
            self._write(nodes, edges, now, keep, self.store.read("embeddings"), (Replaced(gone, new_nodes), Replaced(gone, new_edges)))
            self.terms.change(_indexed(new_nodes), old.join(new_nodes, "id", "left_anti"))
            self.terms.merge()
        return counts

    # Asking.

    def stats(self) -> dict[str, Any]:
        out = first(graph.stats_totals(self.nodes, self.resolved, self.store.read("embeddings")))
        for r in graph.stats_by_type(self.nodes, self.resolved).collect():
            out.setdefault({"node_type": "node_types", "language": "languages", "edge_type": "edge_types"}[r["kind"]], {})[r["value"]] = r["n"]
        return out

    def blast(self, file: str, source: str = "web") -> dict[str, Any]:
        begun = time.time()
        with self.store.staged() as keep:
            found = impact.analyze_file(self.nodes, self.edges, file, keep=keep)
            row = first(impact.risk(found))
            out: dict[str, Any] = {"changed_file": file}
            if row["error"]:
                out["error"] = row["error"]
            out |= {
                "changed_functions": [r["name"] for r in found.changed.orderBy("line").collect()],
                "directly_affected": rows(found.direct.orderBy("path").select("function", "file", "reason", "risk")),
                "indirectly_affected": rows(found.indirect.orderBy("depth", "path").select("function", "file", "reason", "risk")),
                "affected_files": sorted(r["file"] for r in found.files().collect()),
                "affected_file_count": row["affected_file_count"],
                "tests": {"covered": rows(found.covered), "missing": [r["function"] for r in found.missing.orderBy("line").collect()]},
                "risk_score": row["risk_score"],
                "risk_level": row["risk_level"],
                "review_order": [r["entry"] for r in impact.review_order(found).orderBy("step").collect()],
            }
        spent = (time.time() - begun) * 1000
        self._log("blast", file, spent, row["affected_file_count"], source, {"risk_level": row["risk_level"], "risk_score": row["risk_score"], "direct_count": row["n_direct"]})
        return out | {"time_ms": round(spent)}

    def compare(self, file: str) -> dict[str, Any]:
        found = impact.analyze_file(self.nodes, self.edges, file)
        return first(impact.compare(impact.risk(found), self.total_files()))

    def review_context(self, file: str) -> dict[str, Any]:
        begun = time.time()
        found = impact.analyze_file(self.nodes, self.edges, file)
        out = first(impact.review_context(found, impact.risk(found), impact.review_order(found), self.total_files()))
        self._log("review_context", file, (time.time() - begun) * 1000, out["files_reviewed_with_kit"], "claude", {})
        return out

    def search(self, query: str, mode: str = "auto", limit: int = 5, source: str = "web", with_graph: bool = False) -> dict[str, Any]:
        """Ranked nodes by keyword, meaning or both; ``auto`` chooses by the query's shape."""
        if not query:
            return {"results": [], "query": ""}
        begun = time.time()
        asked = mode
        if mode == "auto":
            mode = self.spark.range(1).select(X.query_mode(F.lit(query)).alias("m")).first()["m"]
        k = limit * (retrieval.RERANK_OVERFETCH if self.scorer else 1)
        nodes, shown = self.nodes, ["name", "type", "file", "line", "signature", X.shortened(F.col("docstring")).alias("docstring"), "is_test"]
        if mode == "keyword":
            found = retrieval.keyword_or_like(nodes, query, k, self.index, self.runs).orderBy("place").select(*shown, F.lit(1.0).alias("score"), "bm25")
        elif mode == "semantic":
            vector = self._vector(query) or retrieval.query_vector(self.spark, query, self.store.read("vocabulary"))
            found = retrieval.semantic_search(nodes, self.store.read("embeddings"), vector, k).orderBy(F.col("similarity").desc(), "id").select(*shown, F.col("similarity").alias("score"))
        else:
            found = retrieval.hybrid_search(nodes, self.store.read("embeddings"), self.store.read("vocabulary"), query, k, self.index, self._vector(query))
        results = rows(found)
        if with_graph:
            for r in results:
                around = first(graph.context(nodes, self.edges, r["name"]).where(F.col("function") == r["name"]))
                if around and (around["callers"] or around["callees"] or around["tests"]):
                    r["graph"] = {"callers": [c["name"] for c in around["callers"]], "calls": around["callees"], "tested_by": around["tests"]}
        results = retrieval.rerank(query, results, self.scorer, limit)
        spent = (time.time() - begun) * 1000
        with_ = len({r["file"] for r in results if r.get("file")})
        without = self.total_files().first()["total_files"]
        tokens = with_ * cost.TOKENS_PER_FILE + cost.OVERHEAD_TOKENS, max(without * cost.TOKENS_PER_FILE, 1)
        self._log(f"search:{mode}", query, spent, with_, source, {"result_count": len(results), "mode": mode, "auto": asked == "auto"}, without)
        stats = {"files_with": with_, "files_without": without, "tokens_with": tokens[0], "tokens_without": tokens[1], "reduction": round(tokens[1] / tokens[0], 1)}
        return {"results": results, "query": query, "mode": mode, "reranked": self.scorer is not None, "time_ms": round(spent), "token_stats": stats}

    def _vector(self, query: str) -> list[float] | None:
        return self.encoder.vector(query) if self.encoder else None

    def query_graph(self, name: str, kind: str = "all") -> dict[str, Any]:
        begun = time.time()
        found = graph.query_graph(self.nodes, self.edges, name, kind)
        out = {"function": name} | {k: rows(v.drop("function")) for k, v in found.items()}
        self._log(f"query_graph:{kind}", name, (time.time() - begun) * 1000, graph.files_touched(found), "claude", {})
        return out

    def drawing(self, limit: int | None = None, after: str = "") -> dict[str, Any]:
        """Nodes, by id, and the links that leave them; ``limit`` nodes after the id ``after`` give the graph page by page."""
        nodes, links = graph.graph_nodes(self.nodes), graph.graph_links(self.nodes, self.resolved).select("source", "target", "type")
        if limit is not None:
            nodes = nodes.where(F.col("id") > after).orderBy("id").limit(limit)
            links = links.join(F.broadcast(nodes.select(F.col("id").alias("source"))), "source", "left_semi").select("source", "target", "type")  # a page of ids
        return {"nodes": rows(nodes), "links": rows(links)}

    def activity(self) -> dict[str, Any]:
        items = rows(cost.recent(self.store.activity()))
        for item in items:
            item.update(json.loads(item.pop("extra_json") or "{}"))
        return {"items": items, "totals": first(cost.totals(self.store.activity()))}

    def scenarios(self) -> dict[str, Any]:
        total = self.total_files()
        return {"scenarios": rows(cost.scenarios(total).orderBy("place").drop("place")), "total_files": total.first()["total_files"]}

    def _log(self, op: str, target: str, ms: float, with_: int, source: str, extra: dict, without: int | None = None) -> None:
        if without is None:
            without = self.total_files().first()["total_files"]
        self.store.log(op, target, ms, with_, without, source, extra)
