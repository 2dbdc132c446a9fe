"""Cost estimates and the activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the cost model.
TOKENS_PER_FILE, OVERHEAD_TOKENS, SECONDS_PER_FILE = 800, 400, 2.0
BLAST_SHARE = 0.08
SEARCH_FILES, SEARCH_TOKENS = 10, 120
LOOKUP_FILES = 3
BLAST_SECONDS, SEARCH_SECONDS, LOOKUP_SECONDS = 0.08, 0.15, 0.03
TARGET_CHARS = 80


def tokens_with(files: Column) -> Column:
    return files * TOKENS_PER_FILE + OVERHEAD_TOKENS


def token_stats(found: DataFrame, total_files: DataFrame) -> DataFrame:
    """One row for a search's results: distinct files, tokens with and without, their ratio."""
    files = found.where(F.coalesce("file", F.lit("")) != "").agg(F.count_distinct("file").alias("files_with"))
    out = files.crossJoin(total_files.select(F.col("total_files").alias("files_without")))
    out = out.withColumns({"tokens_with": tokens_with(F.col("files_with")), "tokens_without": F.greatest(F.col("files_without") * TOKENS_PER_FILE, F.lit(1))})
    return out.withColumn("reduction", F.round(F.col("tokens_without") / F.col("tokens_with"), 1))


def scenarios(total_files: DataFrame) -> DataFrame:
    """(place, name, tokens, time_s, files, with_graph): what four ways of reading a project cost."""
    total = F.col("total_files").cast("long")
    blast = F.greatest(F.lit(1), F.bround(total * BLAST_SHARE)).cast("long")
    row = lambda k, name, tokens, seconds, files, graph: F.struct(F.lit(k).alias("place"), F.lit(name).alias("name"), tokens.cast("long").alias("tokens"), seconds.cast("double").alias("time_s"), files.cast("long").alias("files"), F.lit(graph).alias("with_graph"))
    rows = F.array(
        row(1, "Full codebase read", total * TOKENS_PER_FILE, F.round(total * SECONDS_PER_FILE, 1), total, False),
        row(2, "Blast radius analysis", tokens_with(blast), F.lit(BLAST_SECONDS), blast, True),
        row(3, "Semantic / hybrid search", F.lit(SEARCH_FILES * SEARCH_TOKENS + OVERHEAD_TOKENS), F.lit(SEARCH_SECONDS), F.lit(SEARCH_FILES), True),
        row(4, "Targeted function lookup", tokens_with(F.lit(LOOKUP_FILES)), F.lit(LOOKUP_SECONDS), F.lit(LOOKUP_FILES), True),
    )
    return total_files.select(F.explode(rows).alias("r")).select("r.*")


def log_entry(op: Column, target: Column, source: Column, time_ms: Column, files_with: Column, files_without: Column, extra: Column) -> dict[str, Column]:
    """An activity row's columns from the raw measures: estimates, rounding and the cut target."""
    with_, without = tokens_with(files_with), files_without * TOKENS_PER_FILE
    return {
        "op": op, "target": F.substring(target, 1, TARGET_CHARS), "source": source, "time_ms": F.round(time_ms, 2), "files_with": files_with.cast("int"), "files_without": files_without.cast("int"),
        "tokens_with": with_.cast("int"), "tokens_without": without.cast("int"), "reduction": F.round(F.greatest(F.lit(1.0), without / F.greatest(with_, F.lit(1))), 2), "time_without_s": F.round(files_without * SECONDS_PER_FILE, 1), "extra_json": F.to_json(extra),
    }


def recent(log: DataFrame, limit: int = 30) -> DataFrame:
    """The newest entries: a top-k, so each task sends ``limit`` rows."""
    return log.orderBy(F.col("id").desc()).limit(limit)


def totals(log: DataFrame) -> DataFrame:
    """One row: count, tokens_saved (no negative saving), time_saved_s, avg_reduction; zeros for an empty log."""
    saved = F.greatest(F.col("tokens_without") - F.col("tokens_with"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return log.agg(
        F.count("*").alias("count"), zero(F.sum(saved)).alias("tokens_saved"), F.round(zero(F.sum("time_without_s")), 1).alias("time_saved_s"), F.round(zero(F.avg("reduction")), 1).alias("avg_reduction")
    )
