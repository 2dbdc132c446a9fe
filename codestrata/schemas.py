"""The engine's tables. Text is never null in them: '' stands for none."""

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(text: str) -> T.StructType:
    """A schema from ``name type, ...``; no session is needed."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


NODES = _schema(
    "id string, name string, type string, language string, file string, line int, end_line int, signature string, "
    "docstring string, sha256 string, is_test boolean, parent_class string, body_preview string"
)
EDGES = _schema("id bigint, from_id string, to_id string, from_name string, to_name string, type string, file string, line int")
EMBEDDINGS = _schema("node_id string, vector array<float>, model string, text_input string")
FILE_HASHES = _schema("file string, sha256 string, node_count int")
ACTIVITY = _schema(
    "id bigint, ts string, op string, target string, source string, time_ms double, files_with int, files_without int, "
    "tokens_with int, tokens_without int, reduction double, time_without_s double, extra_json string"
)
VOCABULARY = _schema("term string, df bigint, idf double")
LENGTHS = _schema("id string, size bigint")
NAMES = _schema("name string, id string")
RUNS = _schema("run string, id string")
RUN_COUNTS = _schema("run string, n bigint")
TABLES = {"runs": RUNS, "run_counts": RUN_COUNTS, "vocabulary": VOCABULARY, "names": NAMES, "lengths": LENGTHS, "nodes": NODES, "edges": EDGES, "embeddings": EMBEDDINGS, "file_hashes": FILE_HASHES, "activity_log": ACTIVITY}
