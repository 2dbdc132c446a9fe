"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The supported languages and their extensions, in order of precedence.
EXTENSIONS = {
    "python": [".py"],
    "javascript": [".js", ".mjs", ".cjs"],
    "typescript": [".ts"],
    "tsx": [".tsx"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "csharp": [".cs"],
    "ruby": [".rb"],
    "kotlin": [".kt", ".kts"],
    "swift": [".swift"],
    "php": [".php"],
    "solidity": [".sol"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx"],
    "dart": [".dart"],
    "scala": [".scala", ".sc"],
    "r": [".R", ".r"],
    "perl": [".pl", ".pm", ".xs"],
    "lua": [".lua"],
    "vue": [".vue"],
}
#: Languages with a parser of their own; the others share the generic one.
OWN_PARSER = ("python", "javascript", "typescript", "tsx", "go", "java", "rust")


def extension(path: Column) -> Column:
    """The extension with its dot, in lower case; '' for names without one and for dot files."""
    return F.lower(F.regexp_extract(path, r"(?s)(?:^|/)[^/]*[^/.][^/]*(\.[^./]*)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path, or null: a chain of comparisons, folded into the scan's filter."""
    out = F.lit(None).cast("string")
    for language, extensions in reversed(EXTENSIONS.items()):
        out = F.when(extension(path).isin(sorted({e.lower() for e in extensions})), F.lit(language)).otherwise(out)
    return out


def supported_extensions() -> set[str]:
    return {e for extensions in EXTENSIONS.values() for e in extensions}
