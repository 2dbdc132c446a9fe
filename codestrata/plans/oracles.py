"""DuckDB SQL for the queries of ``catalog``."""

from __future__ import annotations

from codestrata.functions.languages import EXTENSIONS
from codestrata.operators.extract import CALL_DENYLIST
from codestrata.plans import fixtures
from codestrata.plans.binding import GRAPH_SQL


def _blast(file: str) -> str:
    """The impact of a file as chained levels."""
    levels = [f"""
changed AS (SELECT name, line, id FROM nodes WHERE file = '{file}' AND type = 'function'),
calls AS (SELECT to_name AS via, from_name AS function, file, id AS edge FROM edges WHERE type = 'calls' AND from_name <> ''),
frontier0 AS (SELECT name AS via, min([CAST(line AS BIGINT)]) AS path FROM changed GROUP BY name)"""]
    for k in (1, 2, 3):
        seen = " AND ".join(f"function NOT IN (SELECT function FROM level{j})" for j in range(1, k)) or "TRUE"
        reason = "'directly calls ' || via" if k == 1 else f"'indirectly affected (depth {k}) via ' || via"
        levels.append(f"""
found{k} AS (SELECT function, list_append(path, edge) AS path, via, file FROM calls JOIN frontier{k - 1} USING (via)),
level{k} AS (
  SELECT {k} AS depth, function, path, file, {reason} AS reason, '{'high' if k == 1 else 'medium' if k == 2 else 'low'}' AS risk
  FROM (SELECT *, row_number() OVER (PARTITION BY function ORDER BY path) AS place FROM found{k}) WHERE place = 1 AND {seen}),
frontier{k} AS (SELECT function AS via, path FROM level{k})""")
    return ",".join([*levels, f"""
affected AS (SELECT * FROM level1 UNION ALL SELECT * FROM level2 UNION ALL SELECT * FROM level3),
test_rows AS (
  SELECT DISTINCT e.to_name AS function, e.from_name AS test_name, e.file AS test_file, e.line, n.signature
  FROM edges e LEFT JOIN nodes n ON n.name = e.from_name WHERE e.type = 'tests'),
covered AS (SELECT t.test_name, t.test_file, c.name AS covers FROM changed c JOIN test_rows t ON t.function = c.name),
missing AS (SELECT name AS function FROM changed WHERE name NOT IN (SELECT to_name FROM edges WHERE type = 'tests') AND NOT starts_with(name, '_')),
dependents AS (SELECT DISTINCT from_name, file FROM edges WHERE type = 'imports' AND to_name ILIKE '%{file}%'),
files AS (SELECT '{file}' AS file UNION SELECT file FROM affected UNION SELECT test_file FROM covered UNION SELECT file FROM dependents),
total AS (SELECT count(DISTINCT file) AS total_files FROM nodes),
counts AS (
  SELECT (SELECT count(*) FROM changed) AS n_changed, (SELECT count(*) FROM level1) AS n_direct, (SELECT count(*) FROM affected WHERE depth > 1) AS n_indirect,
         (SELECT count(*) FROM covered) AS n_covered, (SELECT count(*) FROM missing) AS n_missing, (SELECT count(*) FROM files) AS affected_file_count),
risk AS (
  SELECT '{file}' AS changed_file, n_changed, n_direct, n_indirect, n_covered, n_missing, least(score, 100) AS risk_score,
         CASE WHEN score > 50 THEN 'critical' WHEN score > 30 THEN 'high' WHEN score > 15 THEN 'medium' ELSE 'low' END AS risk_level, affected_file_count
  FROM (SELECT *, n_direct * 3 + n_indirect + n_missing * 5 + greatest(n_changed - 1, 0) * 2 AS score FROM counts)),
direct_files AS (
  SELECT 1 AS grp, path, '' AS name, file, 'direct dependent — ' || reason AS why
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY path) AS place FROM level1 WHERE file <> '{file}') WHERE place = 1),
test_files AS (SELECT DISTINCT 2 AS grp, [CAST(0 AS BIGINT)] AS path, test_file AS name, test_file AS file, 'test file' AS why FROM covered WHERE test_file <> '{file}' AND test_file NOT IN (SELECT file FROM direct_files)),
near AS (SELECT * FROM affected WHERE depth > 1 ORDER BY depth, path LIMIT 5),
indirect_files AS (
  SELECT 2 + depth AS grp, path, '' AS name, file, 'indirect — ' || reason AS why
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY depth, path) AS place FROM near WHERE file <> '{file}' AND file NOT IN (SELECT file FROM direct_files)) WHERE place = 1),
review AS (
  SELECT CAST(row_number() OVER (ORDER BY grp, path, name, file) AS INT) AS step, file, why FROM (
    SELECT 0 AS grp, [CAST(0 AS BIGINT)] AS path, '' AS name, '{file}' AS file, 'the change' AS why
    UNION ALL SELECT * FROM direct_files UNION ALL SELECT * FROM test_files UNION ALL SELECT * FROM indirect_files)),
entries AS (SELECT step, step || '. ' || file || ' (' || why || ')' AS entry FROM review)"""])


def _blast_all() -> str:
    """The risk of each file: levels as above, of pairs of a changed file and a name."""
    levels = ["""
changed AS (SELECT file AS changed_file, name, line FROM nodes WHERE type = 'function'),
calls AS (SELECT to_name AS via, from_name AS function, file, id AS edge FROM edges WHERE type = 'calls' AND from_name <> ''),
frontier0 AS (SELECT changed_file, name AS via, min([CAST(line AS BIGINT)]) AS path FROM changed GROUP BY ALL)"""]
    for k in (1, 2, 3):
        seen = " AND ".join(f"(changed_file, function) NOT IN (SELECT changed_file, function FROM level{j})" for j in range(1, k)) or "TRUE"
        levels.append(f"""
found{k} AS (SELECT changed_file, function, min({{'path': list_append(path, edge), 'file': file}}) AS how FROM calls JOIN frontier{k - 1} USING (via) GROUP BY ALL),
level{k} AS (SELECT {k} AS depth, changed_file, function, how.path AS path, how.file AS file FROM found{k} WHERE {seen}),
frontier{k} AS (SELECT changed_file, function AS via, path FROM level{k})""")
    return ",".join([*levels, """
affected AS (SELECT * FROM level1 UNION ALL SELECT * FROM level2 UNION ALL SELECT * FROM level3),
test_rows AS (
  SELECT DISTINCT e.to_name AS function, e.from_name AS test_name, e.file AS test_file, e.line, n.signature
  FROM edges e LEFT JOIN nodes n ON n.name = e.from_name WHERE e.type = 'tests'),
covered AS (SELECT c.changed_file, t.test_file FROM changed c JOIN test_rows t ON t.function = c.name),
missing AS (SELECT changed_file FROM changed WHERE name NOT IN (SELECT to_name FROM edges WHERE type = 'tests') AND NOT starts_with(name, '_')),
own AS (SELECT DISTINCT file AS changed_file FROM nodes),
touched AS (
  SELECT changed_file, file FROM affected UNION SELECT changed_file, test_file FROM covered UNION SELECT changed_file, changed_file FROM own
  UNION SELECT o.changed_file, e.file FROM own o JOIN edges e ON e.type = 'imports' AND e.to_name ILIKE '%' || o.changed_file || '%'),
counts AS (
  SELECT changed_file, (SELECT count(*) FROM changed x WHERE x.changed_file = o.changed_file) AS n_changed,
         (SELECT count(*) FROM level1 x WHERE x.changed_file = o.changed_file) AS n_direct, (SELECT count(*) FROM affected x WHERE x.changed_file = o.changed_file AND depth > 1) AS n_indirect,
         (SELECT count(*) FROM covered x WHERE x.changed_file = o.changed_file) AS n_covered, (SELECT count(*) FROM missing x WHERE x.changed_file = o.changed_file) AS n_missing,
         (SELECT count(*) FROM touched x WHERE x.changed_file = o.changed_file) AS affected_file_count FROM own o)
SELECT changed_file, n_changed, n_direct, n_indirect, n_covered, n_missing, least(score, 100) AS risk_score,
       CASE WHEN score > 50 THEN 'critical' WHEN score > 30 THEN 'high' WHEN score > 15 THEN 'medium' ELSE 'low' END AS risk_level, affected_file_count
FROM (SELECT *, n_direct * 3 + n_indirect + n_missing * 5 + greatest(n_changed - 1, 0) * 2 AS score FROM counts)"""])


_FOLDED_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_TFIDF_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +'), lambda x: length(x) > 1)"


def _bm25(docs: str, prefixes: list[str]) -> str:
    given = ", ".join(f"('{p}')" for p in prefixes)
    return f"""
tokens AS (SELECT id, unnest({_FOLDED_TOKENS.format('text')}) AS term FROM {docs}),
lengths AS (SELECT id, len({_FOLDED_TOKENS.format('text')}) AS size FROM {docs}),
corpus AS (SELECT count(*) AS n, avg(size) AS mean FROM lengths),
prefixes(prefix) AS (VALUES {given}),
hits AS (SELECT prefix, id, count(*) AS f FROM tokens JOIN prefixes ON starts_with(term, prefix) GROUP BY ALL),
idf AS (SELECT prefix, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT prefix, count(*) AS df FROM hits GROUP BY prefix), corpus),
bm25 AS (
  SELECT id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))) AS score
  FROM hits JOIN idf USING (prefix) JOIN lengths USING (id), corpus GROUP BY id)"""


_COSINE = """
given AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
cosine AS (
  SELECT vec_id AS id, CAST(printf('%.4f', CASE WHEN p * r > 0 THEN list_dot_product(e, q) / (sqrt(p) * sqrt(r)) ELSE 0 END) AS DOUBLE) AS similarity
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, q, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS p, list_dot_product(q, q) AS r FROM embeddings, given))"""



def _vocab(docs: str, key: str) -> str:
    return f"""
doc_terms AS (SELECT {key} AS id, unnest({_TFIDF_TOKENS}) AS term FROM {docs}),
df AS (SELECT term, count(DISTINCT id) AS df FROM doc_terms GROUP BY term),
vocab AS (SELECT term, df, ln((SELECT count(*) FROM {docs}) / (1.0 + df)) AS idf FROM df ORDER BY df DESC, term LIMIT 384)"""


_VOCAB = _vocab("documents", "doc_id")

_WEIGHTS = """w AS (SELECT id, term, count(*) * any_value(idf) AS w FROM doc_terms JOIN vocab USING (term) GROUP BY id, term),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id)
SELECT id, term, round(CASE WHEN norm > 0 THEN w / norm ELSE 0 END, 4) AS w FROM w JOIN norms USING (id)"""

# The documents after the changes that the upkeep queries make.
_UPKEPT = """
upkept AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 20 = 4 THEN 'anon ' || text || ' erthe anon renewed' WHEN doc_id % 10 = 4 THEN text || ' erthe anon renewed' ELSE text END AS text
  FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 20 <> 6)"""


_TEXTS = """
a AS (SELECT function, string_agg(from_name, ' ' ORDER BY place) AS l FROM (SELECT to_name AS function, from_name, file, row_number() OVER (PARTITION BY to_name ORDER BY min(id), from_name, file) AS place FROM edges WHERE type = 'calls' GROUP BY to_name, from_name, file) WHERE place <= 6 GROUP BY function),
b AS (SELECT function, string_agg(to_name, ' ' ORDER BY place) AS l FROM (SELECT from_name AS function, to_name, row_number() OVER (PARTITION BY from_name ORDER BY min(id), to_name) AS place FROM edges WHERE type = 'calls' AND to_name IN (SELECT name FROM nodes) GROUP BY from_name, to_name) WHERE place <= 5 GROUP BY function),
c AS (SELECT function, string_agg(from_name, ' ' ORDER BY place) AS l FROM (SELECT to_name AS function, from_name, row_number() OVER (PARTITION BY to_name ORDER BY min(id), from_name) AS place FROM edges WHERE type = 'tests' GROUP BY to_name, from_name) WHERE place <= 4 GROUP BY function),
texts AS (SELECT n.id, concat_ws(' | ', name, nullif(signature, ''), nullif(docstring, ''), 'File: ' || file, 'Type: ' || type, 'calls: ' || b.l, 'callers: ' || a.l, 'tests: ' || c.l) AS text_input
FROM nodes n LEFT JOIN a ON n.type = 'function' AND a.function = n.name LEFT JOIN b ON n.type = 'function' AND b.function = n.name LEFT JOIN c ON n.type = 'function' AND c.function = n.name)"""

# TF-IDF over the nodes' texts: vectors as (id, place in the vocabulary, single-precision weight).
_VECTORS = """
terms AS (SELECT id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text_input), '[^a-z0-9]', ' ', 'g'), ' +'), lambda x: length(x) > 1)) AS term FROM texts),
node_vocab AS (
  SELECT term, ln((SELECT count(*) FROM texts) / (1.0 + df)) AS idf, CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INT) AS slot
  FROM (SELECT term, count(DISTINCT id) AS df FROM terms GROUP BY term ORDER BY df DESC, term LIMIT 384)),
weights AS (SELECT id, slot, count(*) * any_value(idf) AS w FROM terms JOIN node_vocab USING (term) GROUP BY id, slot),
vectors AS (SELECT id, slot, CAST(w / norm AS FLOAT) AS w FROM weights JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY id) USING (id) WHERE norm > 0),
asked_weights AS (SELECT slot, count(*) * any_value(idf) AS w FROM (SELECT unnest(string_split('{0}', ' ')) AS term) JOIN node_vocab USING (term) GROUP BY slot),
asked AS (SELECT slot, CAST(w / sqrt((SELECT sum(w * w) FROM asked_weights)) AS FLOAT) AS w FROM asked_weights)"""

_NEAREST = """
dots AS (SELECT id, sum(CAST(v.w AS DOUBLE) * CAST(a.w AS DOUBLE)) AS dot FROM vectors v JOIN asked a USING (slot) GROUP BY id),
norms AS (SELECT id, sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) AS norm FROM vectors GROUP BY id),
similar_nodes AS (
  SELECT n.id, CAST(printf('%.4f', coalesce(dot / (norm * (SELECT sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) FROM asked)), 0)) AS DOUBLE) AS similarity
  FROM nodes n LEFT JOIN dots USING (id) LEFT JOIN norms USING (id))"""

_ACTIVITY = """
log AS (
  SELECT event_id AS id, strftime(ts, '%H:%M:%S') AS ts, event_type AS op, 'user ' || user_id AS target, CASE WHEN event_id % 2 = 0 THEN 'web' ELSE 'claude' END AS source,
         round(value, 2) AS time_ms, CAST(user_id % 40 AS INT) AS files_with, CAST((user_id % 40) * 800 + 400 AS INT) AS tokens_with, 20000 AS tokens_without,
         round(greatest(1.0, 20000.0 / greatest((user_id % 40) * 800 + 400, 1)), 2)::DOUBLE AS reduction, 50.0::DOUBLE AS time_without_s, CAST(json_extract(props, '$.k') AS INT) AS k
  FROM events)"""

_PARSED = """
called AS (SELECT CAST(substr(from_name, 10, 9) AS BIGINT) AS key, id, CAST(substr(to_name, 10, 9) AS BIGINT) AS callee FROM edges WHERE type = 'calls'),
keyed AS (
  SELECT *, CASE WHEN key % 10 = 0 THEN 'test_c' ELSE 'c' END || key AS own, CASE WHEN callee % 10 = 0 THEN 'test_c' ELSE 'c' END || callee AS other,
         'src/' || CASE WHEN key % 10 = 0 THEN 'test_f' ELSE 'f' END || key AS base, CASE WHEN key % 10 = 0 THEN 'TestC' ELSE 'C' END || key AS cls,
         CAST(4 + row_number() OVER (PARTITION BY key ORDER BY id) AS INT) AS line
  FROM called),
owners AS (SELECT DISTINCT key, own, base || '.py' AS file, base, cls FROM keyed)"""


def _language_case() -> str:
    whens = " ".join(f"WHEN ext IN ({', '.join(sorted({repr(e.lower()) for e in extensions}))}) THEN '{language}'" for language, extensions in EXTENSIONS.items())
    return f"CASE {whens} END"


def all_sql(file: str, doc_search: str, deleted: str, kept: str, asked: str, node_search: str) -> dict[str, str]:
    g, blast = f"WITH {GRAPH_SQL}", f"WITH {GRAPH_SQL}, {_blast(file)}"
    prefixes = doc_search.split()
    vectors = f"{g}, {_TEXTS}, {_VECTORS.format(node_search)}"
    denied = ", ".join(repr(n) for n in sorted(set(CALL_DENYLIST)))
    node_docs = "node_docs AS (SELECT id, concat_ws(' ', name, signature, docstring, file) AS text FROM nodes)"
    found = {
        "graph_callers": f"{g} SELECT DISTINCT e.to_name AS function, e.from_name, e.file, e.line, n.type, n.signature FROM edges e LEFT JOIN nodes n ON n.name = e.from_name AND n.file = e.file WHERE e.type = 'calls'",
        "graph_callees": f"{g} SELECT DISTINCT from_name AS function, to_name, file, line FROM edges WHERE type = 'calls'",
        "graph_tests_for": f"{g} SELECT DISTINCT e.to_name AS function, e.from_name AS test_name, e.file AS test_file, e.line, n.signature FROM edges e LEFT JOIN nodes n ON n.name = e.from_name WHERE e.type = 'tests'",
        "graph_dependents": f"{g} SELECT DISTINCT f.file AS imported, e.from_name, e.file FROM (SELECT DISTINCT file FROM nodes) f JOIN edges e ON e.type = 'imports' AND e.to_name ILIKE '%' || f.file || '%'",
        "graph_dependents_of": f"{g} SELECT DISTINCT from_name, file FROM edges WHERE type = 'imports' AND to_name ILIKE '%{file}%'",
        "graph_query": f"""{g}
SELECT DISTINCT 'callers' AS kind, e.from_name AS name, e.file, e.line FROM edges e WHERE e.type = 'calls' AND e.to_name = '{asked}'
UNION ALL SELECT DISTINCT 'callees', to_name, file, line FROM edges WHERE type = 'calls' AND from_name = '{asked}'
UNION ALL SELECT DISTINCT 'tests', from_name, file, line FROM edges WHERE type = 'tests' AND to_name = '{asked}'""",
        "all_nodes": f"{g} SELECT id, name, type, file, line FROM nodes",
        "all_edges": f"{g} SELECT id, from_name, to_name, type, file, line FROM edges",
        "node_lookup": f"{g} SELECT id, name, type, file FROM nodes WHERE name = '{file}' AND type = 'class'",
        "graph_context": f"""{g},
who_calls AS (SELECT to_name AS function, from_name, file, row_number() OVER (PARTITION BY to_name ORDER BY min(id), from_name, file) AS place FROM edges WHERE type = 'calls' GROUP BY to_name, from_name, file),
what AS (SELECT from_name AS function, to_name, row_number() OVER (PARTITION BY from_name ORDER BY min(id), to_name) AS place FROM edges WHERE type = 'calls' AND to_name IN (SELECT name FROM nodes) GROUP BY from_name, to_name),
tested AS (SELECT to_name AS function, from_name, row_number() OVER (PARTITION BY to_name ORDER BY min(id), from_name) AS place FROM edges WHERE type = 'tests' GROUP BY to_name, from_name)
SELECT function, coalesce(a.l, '') AS callers, coalesce(b.l, '') AS callees, coalesce(c.l, '') AS tests
FROM (SELECT function, string_agg(from_name || '@' || file, ',' ORDER BY place) AS l FROM who_calls WHERE place <= 10 GROUP BY function) a
FULL JOIN (SELECT function, string_agg(to_name, ',' ORDER BY place) AS l FROM what WHERE place <= 5 GROUP BY function) b USING (function)
FULL JOIN (SELECT function, string_agg(from_name, ',' ORDER BY place) AS l FROM tested WHERE place <= 5 GROUP BY function) c USING (function)""",
        "graph_stats_totals": f"{g} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(DISTINCT file) FROM nodes) AS total_files, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM embeddings) AS total_embeddings",
        "graph_stats_by_type": f"{g} SELECT 'node_type' AS kind, type AS value, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'language', language, count(*) FROM nodes GROUP BY language UNION ALL SELECT 'edge_type', type, count(*) FROM edges GROUP BY type",
        "graph_d3_nodes": f"{g} SELECT id, name, type, file, CAST(is_test AS INT) AS is_test FROM nodes",
        "graph_d3_links": f"""{g}, by_name AS (SELECT name, arg_max(id, file || '/' || lpad(CAST(line AS VARCHAR), 12, '0')) AS found FROM nodes GROUP BY name)
SELECT e.id AS edge_id, s.found AS source, t.found AS target, e.type FROM edges e JOIN by_name s ON s.name = e.from_name JOIN by_name t ON t.name = e.to_name""",
        "edge_resolution": f"{g} SELECT e.id, e.from_name, e.to_name, e.type, coalesce(n.id, '') AS to_id FROM edges e LEFT JOIN nodes n ON e.type = 'calls' AND n.name = e.to_name",
        "nodes_by_file": f"{g} SELECT id, name, type, line, signature, is_test FROM nodes WHERE file = '{file}'",
        "analyze_functions": f"""{g},
c1 AS (SELECT to_name AS function, count(*) AS n FROM (SELECT DISTINCT e.to_name, e.from_name, e.file, e.line, n.type, n.signature FROM edges e LEFT JOIN nodes n ON n.name = e.from_name AND n.file = e.file WHERE e.type = 'calls') GROUP BY 1),
c2 AS (SELECT from_name AS function, count(*) AS n FROM (SELECT DISTINCT from_name, to_name, file, line FROM edges WHERE type = 'calls') GROUP BY 1),
c3 AS (SELECT to_name AS function, count(*) AS n FROM (SELECT DISTINCT e.to_name, e.from_name, e.file, e.line, n.signature FROM edges e LEFT JOIN nodes n ON n.name = e.from_name WHERE e.type = 'tests') GROUP BY 1)
SELECT f.function, coalesce(c1.n, 0) AS caller_count, coalesce(c2.n, 0) AS callee_count, coalesce(c3.n, 0) AS test_count, coalesce(c3.n, 0) > 0 AS has_tests
FROM (SELECT DISTINCT name AS function FROM nodes WHERE type = 'function') f LEFT JOIN c1 USING (function) LEFT JOIN c2 USING (function) LEFT JOIN c3 USING (function)""",
        "blast_direct": f"{blast} SELECT function, file, reason, risk FROM level1",
        "blast_indirect": f"{blast} SELECT depth, function, file, reason, risk FROM affected WHERE depth > 1",
        "blast_tests_covered": f"{blast} SELECT * FROM covered",
        "blast_tests_missing": f"{blast} SELECT * FROM missing",
        "blast_files": f"{blast} SELECT * FROM files",
        "blast_risk": f"{blast} SELECT * FROM risk",
        "blast_all": f"{g}, {_blast_all()}",
        "blast_review_order": f"{blast} SELECT * FROM entries",
        "compare_cost": f"""{blast}
SELECT changed_file, total_files AS files_without, least(affected_file_count, total_files) AS files_with, total_files * 800 AS tokens_without, least(affected_file_count, total_files) * 800 AS tokens_with,
       printf('%.1fx', greatest(1.0, total_files / least(affected_file_count, total_files))) AS token_reduction, total_files - least(affected_file_count, total_files) AS files_saved, affected_file_count >= total_files AS full_codebase_impact
FROM risk, total""",
        "review_context": f"""{blast}
SELECT changed_file, risk_level, risk_score, printf('%.1fx', round(total_files / n, 1)) AS token_savings, CAST(n AS INT) AS files_reviewed_with_kit, total_files AS total_project_files,
       (SELECT string_agg(entry, '; ' ORDER BY step) FROM entries) AS files_to_review, coalesce((SELECT string_agg(function, ',' ORDER BY function) FROM missing), '') AS missing,
       CASE WHEN n_missing > 0 THEN n_missing || ' functions have NO tests' END AS warning, n_indirect AS indirect_impact_count
FROM risk, total, (SELECT greatest(count(*), 1) AS n FROM entries)""",
        "token_scenarios": f"""{g}, t AS (SELECT count(DISTINCT file) AS n, greatest(1, CAST(round_even(count(DISTINCT file) * 0.08, 0) AS BIGINT)) AS b FROM nodes)
SELECT 1 AS place, 'Full codebase read' AS name, n * 800 AS tokens, round(n * 2.0, 1)::DOUBLE AS time_s, n AS files, FALSE AS with_graph FROM t
UNION ALL SELECT 2, 'Blast radius analysis', b * 800 + 400, 0.08, b, TRUE FROM t
UNION ALL SELECT 3, 'Semantic / hybrid search', 1600, 0.15, 10, TRUE FROM t
UNION ALL SELECT 4, 'Targeted function lookup', 2800, 0.03, 3, TRUE FROM t""",
        "activity_recent": f"WITH {_ACTIVITY} SELECT id, ts, op, target, source, time_ms, files_with, tokens_with, tokens_without, reduction, time_without_s, k FROM log ORDER BY id DESC LIMIT 30",
        "activity_totals": f"WITH {_ACTIVITY} SELECT count(*) AS count, CAST(sum(greatest(tokens_without - tokens_with, 0)) AS BIGINT) AS tokens_saved, round(sum(time_without_s), 1) AS time_saved_s, round(avg(reduction), 1) AS avg_reduction FROM log",
        "search_token_stats": f"""{g}, found AS (SELECT * FROM nodes WHERE name ILIKE '%machinery%' OR signature ILIKE '%machinery%' OR docstring ILIKE '%machinery%' ORDER BY name, id LIMIT 50),
s AS (SELECT (SELECT count(DISTINCT file) FROM found) AS files_with, (SELECT count(DISTINCT file) FROM nodes) AS files_without)
SELECT files_with, files_without, files_with * 800 + 400 AS tokens_with, greatest(files_without * 800, 1) AS tokens_without, round(greatest(files_without * 800, 1) / (files_with * 800 + 400), 1) AS reduction FROM s""",
        "doc_tokens": f"WITH {_VOCAB} SELECT id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM doc_terms GROUP BY id",
        "doc_df": f"WITH {_VOCAB} SELECT term, df FROM df",
        "tfidf_vocab": f"WITH {_VOCAB} SELECT term, df, round(idf, 6) AS idf FROM vocab",
        "index_upkeep_search": f"WITH {_UPKEPT}, {_bm25('upkept', prefixes)} SELECT id, round(score, 4) AS score FROM bm25",
        "index_upkeep_df": f"WITH {_UPKEPT}, {_vocab('upkept', 'id')} SELECT term, df FROM df",
        "vector_upkeep": f"WITH {_UPKEPT}, {_vocab('upkept', 'id')}, {_WEIGHTS}",
        "tfidf_weights": f"WITH {_VOCAB}, {_WEIGHTS}",
        "bm25_scores": f"WITH d AS (SELECT doc_id AS id, text FROM documents), {_bm25('d', prefixes)} SELECT id, round(score, 4) AS score FROM bm25",
        "keyword_search": f"""{g}, {node_docs}, {_bm25('node_docs', ['machinery', 'customer', 'nation', '3'])},
best AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, id) - 1 AS INT) AS place, id, round(score, 4) AS bm25 FROM bm25 ORDER BY score DESC, id LIMIT 20)
SELECT place, id, name, bm25 FROM best JOIN nodes USING (id)""",
        "like_search": f"{g} SELECT id, name FROM nodes WHERE name ILIKE '%machinery%' OR signature ILIKE '%machinery%' OR docstring ILIKE '%machinery%' ORDER BY name, id LIMIT 50",
        "part_name_matches": """
WITH asked AS (
  SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN substr(p_name, 3, 4) WHEN 1 THEN substr(p_type, 1, 2) WHEN 2 THEN substr(p_name, 2, 2) || '_' || substr(p_name, 5, 2)
    WHEN 3 THEN upper(substr(p_name, 4, 5)) WHEN 4 THEN substr(p_type, 1, 1) ELSE '__' END AS pattern FROM part)
SELECT pattern, count(*) AS n FROM asked JOIN part ON p_name ILIKE '%' || pattern || '%' GROUP BY pattern""",
        "query_mode": r"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN (SELECT string_agg(upper(substr(w, 1, 1)) || lower(substr(w, 2)), '' ORDER BY k) FROM (SELECT unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS k))
  WHEN 2 THEN p_name WHEN 3 THEN split_part(p_name, ' ', 1) || replace(p_brand, '#', '') ELSE p_type END AS asked FROM part)
SELECT p_partkey, asked, CASE WHEN regexp_matches(asked, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') OR regexp_matches(asked, '^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)+$') OR regexp_matches(asked, '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$') THEN 'keyword' ELSE 'hybrid' END AS mode FROM p""",
        "cosine_topk": f"WITH {_COSINE} SELECT id, similarity FROM cosine ORDER BY similarity DESC, id LIMIT 20",
        "nearest_of_many": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (
  SELECT q.vec_id AS query, n.vec_id AS id, CAST(printf('%.4f', CASE WHEN q.norm * n.norm > 0 THEN list_dot_product(q.e, n.e) / (q.norm * n.norm) ELSE 0 END) AS DOUBLE) + 0.0 AS similarity
  FROM n q JOIN n ON q.vec_id % 50 = 0)
SELECT query, id, similarity, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM s) WHERE place <= 10""",
        "rerank_lists": """
WITH lists AS (
  SELECT p_brand AS query_id, p_brand || CASE substr(p_brand, 7, 1) WHEN '3' THEN ' test' WHEN '4' THEN ' of' ELSE '' END AS query, p_partkey AS id,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, p_partkey % 3 = 0 AS is_test, p_name || ' ' || p_type AS document FROM part),
scored AS (SELECT *, ((length(query) * 7 + length(document) * 13) % 101 - CASE WHEN length(query) % 4 = 0 THEN 120 ELSE 60 END) / 16.0 AS raw FROM lists WHERE place <= 20),
guarded AS (SELECT *, CASE WHEN count(*) OVER w > 1 AND max(raw) OVER w >= 0 THEN raw * CASE WHEN is_test AND NOT contains(query, 'test') THEN 0.5 ELSE 1 END END AS score FROM scored WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, CAST(printf('%.4f', CAST(score AS DOUBLE)) AS DOUBLE) AS rerank_score, CAST(now AS INT) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, place, id) AS now FROM guarded) WHERE now <= 5""",
        "hybrid_topk": f"""WITH d AS (SELECT doc_id AS id, text FROM documents), {_bm25('d', prefixes)}, {_COSINE},
said AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM bm25 ORDER BY score DESC, id LIMIT 40),
near AS (SELECT id, similarity FROM cosine ORDER BY similarity DESC, id LIMIT 40),
scored AS (
  SELECT coalesce(said.id, near.id) AS id, place, similarity,
         coalesce(0.4 / (1.0 + place), 0) + coalesce(0.6 * (similarity - (SELECT min(similarity) FROM near)) / greatest((SELECT max(similarity) - min(similarity) FROM near), 1e-6), 0) AS raw
  FROM said FULL JOIN near ON said.id = near.id),
weighed AS (SELECT s.id, place, similarity, CASE WHEN d.id IS NOT NULL AND s.id % 10 = 0 THEN raw * 0.65 ELSE raw END AS score FROM scored s LEFT JOIN d ON d.id = s.id)
SELECT id, CAST(printf('%.4f', score) AS DOUBLE) AS score FROM weighed WHERE score >= 0.1 ORDER BY score DESC, place ASC NULLS LAST, similarity DESC NULLS LAST, id LIMIT 20""",
        "embedding_texts": f"{g}, {_TEXTS} SELECT id, text_input FROM texts",
        "shown_texts": r"SELECT doc_id AS id, CASE WHEN length(text) > 120 THEN regexp_replace(substr(text, 1, 120), '[\s\x1c-\x1f]+$', '') || '…' ELSE text END AS shown, regexp_matches(lower(text), 'test|spec|fixture|mock') AS wants_tests FROM documents",
        "embed_nodes": f"{vectors} SELECT id AS node_id, slot, CAST(printf('%.3f', CAST(w AS DOUBLE)) AS DOUBLE) + 0.0 AS w FROM vectors WHERE w <> 0",
        "embed_query": f"{vectors} SELECT places.slot, CAST(printf('%.3f', coalesce(CAST(w AS DOUBLE), 0)) AS DOUBLE) + 0.0 AS w FROM (SELECT CAST(unnest(range(384)) AS INT) AS slot) places LEFT JOIN asked USING (slot)",
        "semantic_search": f"{vectors}, {_NEAREST} SELECT id, name, file, CAST(printf('%.3f', similarity) AS DOUBLE) AS similarity FROM (SELECT * FROM similar_nodes ORDER BY similarity DESC, id LIMIT 20) JOIN nodes USING (id)",
        "hybrid_search": f"""{vectors}, {_NEAREST}, {node_docs}, {_bm25('node_docs', node_search.split())},
said AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM bm25 ORDER BY score DESC, id LIMIT 40),
near AS (SELECT id, similarity FROM similar_nodes ORDER BY similarity DESC, id LIMIT 40),
scored AS (
  SELECT coalesce(said.id, near.id) AS id, place, similarity,
         coalesce(0.4 / (1.0 + place), 0) + coalesce(0.6 * (similarity - (SELECT min(similarity) FROM near)) / greatest((SELECT max(similarity) - min(similarity) FROM near), 1e-6), 0) AS raw
  FROM said FULL JOIN near ON said.id = near.id),
best AS (SELECT s.id, CASE WHEN is_test THEN raw * 0.65 ELSE raw END AS score FROM scored s JOIN nodes n ON n.id = s.id
  WHERE CASE WHEN is_test THEN raw * 0.65 ELSE raw END >= 0.1 ORDER BY score DESC, place ASC NULLS LAST, similarity DESC NULLS LAST, s.id LIMIT 20)
SELECT id AS node_id, name, file, CAST(printf('%.4f', score) AS DOUBLE) AS score FROM best JOIN nodes USING (id)""",
        "embedding_nodes": "SELECT vec_id, label, lang, source, CAST(len(embedding) AS INT) AS dim FROM embeddings JOIN documents ON vec_id = doc_id",
        "extract_nodes": f"""{g}, {_PARSED}
SELECT substr(md5(file || '::' || name || '::' || line), 1, 12) AS id, name, type, 'python' AS language, file, line, signature, docstring, is_test, parent_class FROM (
  SELECT file, cls AS name, 'class' AS type, 2 AS line, 'class ' || cls || '(Base, object)' AS signature, '' AS docstring, key % 10 = 0 AS is_test, '' AS parent_class FROM owners
  UNION ALL SELECT file, own, 'function', 3, 'def ' || own || '(self, a) -> int', 'Runs it.', key % 10 = 0, cls FROM owners)""",
        "tree_sources": fixtures.tree_sql(raw=False),
        "tree_hashes": fixtures.tree_sql(raw=True),
        **{f"extract_{name}_nodes": fixtures.nodes_sql(x) for name, x in fixtures.FIXTURES.items()},
        **{f"extract_{name}_edges": fixtures.edges_sql(x) for name, x in fixtures.FIXTURES.items() if x.edges},
        "extract_edges": f"""{g}, {_PARSED}
SELECT base || '.py' AS file, 'calls' AS type, own AS from_name, other AS to_name, line FROM keyed WHERE own <> other
UNION ALL SELECT base || '.py', 'tests', own, other, 3 FROM keyed WHERE own <> other AND key % 10 = 0
UNION ALL SELECT file, 'inherits', cls, 'Base', 2 FROM owners
UNION ALL SELECT file, 'member_of', own, cls, 3 FROM owners
UNION ALL SELECT file, 'imports', replace(base, '/', '.'), 'base', 1 FROM owners""",
        "line_scan": r"SELECT doc_id, CAST(k AS INT) AS line, CAST(length(txt) AS INT) AS size, CAST(length(txt) - length(regexp_replace(txt, '^\s+', '')) AS INT) AS indent FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)",
        "script_calls": rf"SELECT page_id, called, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(\w+)\s*\(', 1)) AS called FROM pages) WHERE called NOT IN ({denied}) GROUP BY page_id, called",
        "node_ids": "SELECT o_orderkey, substr(md5(o_orderpriority || '::' || o_orderstatus || '::' || o_orderkey), 1, 12) AS id, substr(sha256(o_orderpriority), 1, 16) AS hash FROM orders",
        "file_languages": f"""
WITH p AS (SELECT p_partkey, replace(p_name, ' ', '/') AS base, ['.py', '.JS', '.tsx', '.rs', '.kts', '.h', '.txt', ''][p_partkey % 8 + 1] AS given, lower(['.py', '.JS', '.tsx', '.rs', '.kts', '.h', '.txt', ''][p_partkey % 8 + 1]) AS ext FROM part)
SELECT p_partkey, {_language_case()} AS language, replace('src/' || base, '/', '.') AS module, split_part(base, '/', -1) AS stem FROM p""",
        "generated_skip": r"""
SELECT page_id FROM pages WHERE NOT (regexp_matches('/' || url, '_pb2\.py$|_pb2_grpc\.py$|[/\\]migrations[/\\]\d+_|\.generated\.') OR contains(substr(html, 1, 500), '# Generated by') OR contains(substr(html, 1, 500), '# DO NOT EDIT')
  OR contains(substr(html, 1, 500), '# @generated') OR contains(substr(html, 1, 500), '// Code generated by'))""",
        "upsert_nodes": f"{g} SELECT id, name, file, line, CASE WHEN line % 3 = 0 THEN signature || ' -> int | None' ELSE signature END AS signature FROM nodes",
        "append_edges": f"{g} SELECT type, 2 * count(*) AS n, count(DISTINCT id) AS ids FROM edges GROUP BY type UNION ALL SELECT 'again_' || type, count(*), count(DISTINCT id) FROM edges GROUP BY type",
        "file_hash_lookup": f"{g} SELECT file, substr(md5(CAST(count(*) AS VARCHAR)), 1, 16) AS sha256 FROM nodes WHERE file = '{file}' GROUP BY file",
        "set_file_hashes": f"{g} SELECT file, reverse(substr(md5(CAST(count(*) AS VARCHAR)), 1, 16)) AS sha256 FROM nodes GROUP BY file UNION ALL SELECT r_name, substr(md5(r_name), 1, 16) FROM region",
        "store_embeddings": """SELECT CAST(vec_id AS VARCHAR) AS node_id, CAST(len(embedding) AS INT) AS dim, CAST(CASE WHEN label = 0 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE) AS first FROM embeddings
UNION ALL SELECT 'new-' || vec_id, CAST(len(embedding) AS INT), CAST(-embedding[1] AS DOUBLE) FROM embeddings WHERE label <> 0""",
        "reindex_nodes": f"""{g} SELECT id, name, type, file, line, signature FROM nodes WHERE file NOT IN ('{file}', '{deleted}')
UNION ALL SELECT substr(md5('{file}::fresh::1'), 1, 12), 'fresh', 'function', '{file}', 1, 'def fresh()' UNION ALL SELECT substr(md5('{file}::stays::4'), 1, 12), 'stays', 'function', '{file}', 4, 'def stays()'""",
        "reindex_edges": f"""{g}, now AS (
  SELECT from_name, to_name, type, file, line FROM edges WHERE file NOT IN ('{file}', '{deleted}')
  UNION ALL SELECT 'fresh', 'stays', 'calls', '{file}', 2 UNION ALL SELECT 'stays', '{deleted}', 'calls', '{file}', 5 UNION ALL SELECT 'stays', '{kept}', 'calls', '{file}', 6),
targets AS (SELECT id, name FROM nodes WHERE file NOT IN ('{file}', '{deleted}') UNION ALL SELECT substr(md5('{file}::stays::4'), 1, 12), 'stays')
SELECT from_name, to_name, n.type, n.file, n.line, coalesce(t.id, '') AS to_id FROM now n LEFT JOIN targets t ON n.type = 'calls' AND t.name = n.to_name""",
        "reindex_vectors": f"{g} SELECT id AS node_id, name AS text_input FROM nodes WHERE file NOT IN ('{file}', '{deleted}')",
        "clear_file": f"{g} SELECT 'nodes' AS table_name, file, count(*) AS n FROM nodes WHERE file <> '{file}' GROUP BY file UNION ALL SELECT 'edges', file, count(*) FROM edges WHERE file <> '{file}' GROUP BY file",
        "tree_of_one_language": "SELECT 'pkg/d3/m' || c_custkey || '.py' AS file, 'python' AS language, CAST(length('def f' || c_custkey || '():') + 10 AS INT) AS size FROM customer WHERE c_custkey % 7 = 3",
        "replace_one_file": f"{g} SELECT id, name, file, CASE WHEN file = '{file}' THEN signature || ' -> int' ELSE signature END AS signature FROM nodes",
        "clear_embeddings": f"{g} SELECT id AS node_id, name AS text_input FROM nodes WHERE file <> '{file}'",
        "rename_file": f"{g} SELECT id, name, CASE WHEN file = '{file}' THEN 'NATION_X' ELSE file END AS file FROM nodes",
        "snapshot_diff": """
WITH a AS (SELECT user_id || '/' || event_type || '/' || hour(ts) AS file, md5(CAST(sum(event_id % 3) AS VARCHAR)) AS h FROM events WHERE day(ts) <= 15 GROUP BY 1),
b AS (SELECT user_id || '/' || event_type || '/' || hour(ts) AS file, md5(CAST(sum(event_id % 3) AS VARCHAR)) AS h FROM events WHERE day(ts) > 15 GROUP BY 1)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.file = b.file WHERE a.h IS NULL OR b.h IS NULL OR substr(a.h, 1, 16) <> substr(b.h, 1, 16)""",
        "rename_match": """
WITH e AS (SELECT CASE WHEN event_type IN ('error', 'view', 'signup') THEN 'delete' ELSE 'create' END AS kind, 'f' || event_id AS file, CAST(user_id AS VARCHAR) AS hash, ts FROM events),
s AS (SELECT *, lag(kind) OVER w AS k, lag(file) OVER w AS f, lag(ts) OVER w AS t FROM e WINDOW w AS (PARTITION BY hash ORDER BY ts, kind, file))
SELECT hash, f AS old_file, file AS new_file, ts FROM s WHERE kind = 'create' AND k = 'delete' AND ts <= t + INTERVAL 24 HOUR""",
        "debounce": """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS file, ts FROM events),
taken AS (
  SELECT file, min(ts) AS ts FROM e GROUP BY file
  UNION ALL
  SELECT t.file, (SELECT min(e.ts) FROM e WHERE e.file = t.file AND e.ts >= t.ts + INTERVAL 6 HOUR) AS ts FROM taken t WHERE t.ts IS NOT NULL)
SELECT file, ts FROM taken WHERE ts IS NOT NULL""",
        "event_stream_counts": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    }
    # A stream over a table's files gives what the operator gives for the table.
    return found | {"stream_debounce": found["debounce"], "stream_renames": found["rename_match"]}
