"""The training-data operators' queries by name, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import bpe, decontaminate, html_text, line_dedup, minhash, pipeline, quality, runs, secret_scan, simhash, token_counts, url_filter, vector_codes, warc
from codestrata.llm.arrow import spread
from codestrata.llm.scratch import Scratch

BPE_RANKS = pipeline.BPE_RANKS
COUNTED_TOKENIZER = "word_bpe_49k.json"
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "text", "n_chars")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, ids=False)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The cache is the run's own, so that a run counts its whole table; a production job names a lasting path.
    cache = token_counts.DigestCache(spark, Scratch(spark, "counts").path("cache"))
    return token_counts.count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(COUNTED_TOKENIZER), cache)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(spark, table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(spread(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).drop("text")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "lines_in", "lines_out", "text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.write_and_read(spread(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(spread(table(spark, sf_dir, "documents")))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(_spelled(of(*secret_scan.BASE)), 256).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The texts of op12: where crc32 of the id is divisible by ten, the words from a place on repeat a stretch of the text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")

    def repeated(s: Column) -> Column:
        n = F.size(s["words"])
        a = s["g"] % n
        p = 1 + F.floor((n - a) / (3 + s["g"] % 8))
        bound = F.array(F.struct(s["words"].alias("words"), a.alias("a"), p.alias("p")))
        return F.transform(bound, lambda b: F.array_join(F.transform(b["words"], lambda w, i: F.when(i < b["a"], w).otherwise(b["words"][(b["a"] + (i - b["a"]) % b["p"]).cast("int")])), " "))[0]

    text = F.transform(F.array(F.struct(words.alias("words"), g.alias("g"))), lambda s: F.when(F.size(s["words"]) > 0, repeated(s)).otherwise(F.lit("")))[0]
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periods(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    found = runs.find_runs(docs, texts=False)
    # The greatest run: by length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spread(table(spark, sf_dir, "embeddings")))


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0, 's')) + 1), '^[^?#]*', 0, 's'), '') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS place FROM fits)
WHERE place = 1
"""


def _op11_sql() -> str:
    """Spans by lists and windows, links by plain interval conditions."""
    kinds = {"assign": secret_scan.ASSIGN, "access": secret_scan.ACCESS, "hex": secret_scan.HEX, "identifier": secret_scan.IDENTIFIER, "secret": secret_scan.SECRET, "endpoint": secret_scan.ENDPOINT, "blank": secret_scan.BLANK}
    each = []
    for kind, pattern in kinds.items():
        quoted = "'" + pattern.replace("'", "''") + "'"
        each.append(f"SELECT doc_id, '{kind}' AS kind, string_split_regex(t, {quoted}) AS pieces, regexp_extract_all(t, {quoted}, 0) AS hits, regexp_extract_all(t, {quoted}, {2 if kind == 'assign' else 0}) AS parts FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({" UNION ALL ".join(each)}),
hit AS (
  SELECT doc_id, kind, k, length(pieces[k]) AS gap, hits[k] AS hit, parts[k] AS part
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM matched)),
placed AS (SELECT *, CAST(sum(gap + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS e FROM hit),
good AS (
  SELECT doc_id, kind, e - length(hit) AS s, e FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(part) >= 6
    WHEN 'secret' THEN NOT regexp_full_match(hit, '[A-Za-z0-9+/]+') OR (length(hit) = 40 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]'))
    ELSE TRUE END),
base AS (SELECT * FROM good WHERE kind IN ('assign', 'access', 'hex')),
span AS (
  SELECT g.*, (SELECT count(*) FROM good b WHERE b.kind = 'blank' AND b.doc_id = g.doc_id AND b.s < g.s) AS scope
  FROM good g
  WHERE g.kind <> 'blank' AND (g.kind IN ('assign', 'access', 'hex') OR NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = g.doc_id AND b.s < g.e AND b.e > g.s))),
link AS (
  SELECT a.doc_id, a.kind AS ak, a.s AS "as", a.e AS ae, a.scope, b.kind AS bk, b.s AS bs, b.e AS be
  FROM span a JOIN span b ON a.doc_id = b.doc_id AND a.scope = b.scope
    AND (b.s - a.e BETWEEN 0 AND 400 OR a.s - b.e BETWEEN 0 AND 400)
  WHERE a.kind IN ('identifier', 'access') AND b.kind IN ('secret', 'assign', 'hex')),
reported AS (
  SELECT doc_id, kind, s, e FROM base
  UNION SELECT doc_id, ak, "as", ae FROM link WHERE ak = 'identifier'
  UNION SELECT doc_id, bk, bs, be FROM link WHERE bk = 'secret'
  UNION SELECT l.doc_id, p.kind, p.s, p.e FROM link l JOIN span p ON p.doc_id = l.doc_id AND p.scope = l.scope AND p.kind = 'endpoint'
    AND (p.s - l.ae BETWEEN 0 AND 400 OR l."as" - p.e BETWEEN 0 AND 400)),
listed AS (
  SELECT doc_id, kind, kind || ':' || s || ':' || e AS spelled, s, e, list_position(['assign', 'access', 'hex', 'identifier', 'secret', 'endpoint'], kind) AS place
  FROM reported)
SELECT d.doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(spelled, ',' ORDER BY s, place, e) FILTER (place <= 3), '')) AS base_sha256,
  coalesce(string_agg(spelled, ',' ORDER BY s, place, e), '') AS spans
FROM d LEFT JOIN listed USING (doc_id) GROUP BY d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_token_counts": op3_token_counts,
        "op4_decontaminate": op4_decontaminate,
        "op5_url_filter": op5_url_filter,
        "op6_minhash": op6_minhash,
        "op7_quality": op7_quality,
        "op8_line_dedup": op8_line_dedup,
        "op9_warc": op9_warc,
        "op10_simhash": op10_simhash,
        "op11_secrets": op11_secrets,
        "op12_runs": op12_runs,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op11_secrets": _op11_sql()}
