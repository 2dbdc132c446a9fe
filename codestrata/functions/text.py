"""Scalar functions on names, paths, lines and queries: built-in expressions only."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import folds

#: White space as the line rules mean it: Unicode's, and the four ASCII separators.
_WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Words whose presence means that a query asks for tests.
TEST_WORDS = "test|spec|fixture|mock"


def strip_left(c: Column) -> Column:
    return F.ltrim(c, F.lit(_WS))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_WS))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WS))


def node_id(file: Column, name: Column, line: Column) -> Column:
    """Twelve hex digits from file, name and line."""
    return F.substring(F.md5(F.concat_ws("::", file, name, line.cast("string"))), 1, 12)


def content_hash(source: Column) -> Column:
    """Sixteen hex digits of a text's or file's SHA-256."""
    return F.substring(F.sha2(source, 256), 1, 16)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_extension(path: Column) -> Column:
    """The path up to its last dot, if that dot follows a character of the name that is no dot."""
    return F.regexp_replace(path, r"(?s)^((?:.*/)?[^/]*[^/.][^/]*)\.[^./]*$", "$1")


def module_name(path: Column) -> Column:
    return F.replace(without_extension(path), F.lit("/"), F.lit("."))


def stem(path: Column) -> Column:
    return without_extension(basename(path))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c) for c in pattern)
    return f"(?s)^{out}$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | name.rlike(glob_regex(pattern))
    return out


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def query_terms(query: Column) -> Column:
    """A keyword query's terms: camel case and snake case split, white space between."""
    return F.filter(F.split(F.translate(split_camel(query), "_", " "), r"(?U)\s+"), lambda x: x != "")


def index_tokens(c: Column) -> Column:
    """Full-text tokens: lower case without accents, split at all that is no letter or number."""
    # Of ASCII texts nothing is folded: their characters are not looked up.
    plain = lambda x: F.when(x.rlike("[^\\x00-\\x7F]"), F.translate(x, *_folded())).otherwise(x)
    return F.filter(F.split(folds.bound(F.lower(c), plain), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def counted(tokens: Column) -> Column:
    """(term, tf) of each distinct token, by term: runs of the sorted array, counted inside the row."""

    def runs(words: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        length = lambda at: F.transform(at, lambda i, k: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(words)) - i).cast("long").alias("tf")))
        return F.when(F.size(words) > 0, folds.bound(first, length)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return folds.bound(F.sort_array(tokens), runs)


@cache
def _folded() -> tuple[str, str]:
    """Characters and what stands for them, by their own decompositions: of a letter with marks the letter stays, marks go.

    (``translate`` deletes the characters at the end that nothing stands for.) No
    character decomposes into several without marks. Hangul letters that were
    written apart are not joined.
    """
    folded = {}
    for k in (*range(0x80, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0100, 0xE01F0)):
        bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", chr(k)) if unicodedata.category(x)[0] != "M"))
        if bare != chr(k):
            folded[chr(k)] = bare
    pairs = sorted(folded.items(), key=lambda pair: not pair[1])
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tfidf_tokens(c: Column) -> Column:
    """Vector tokens: ASCII letters and digits in lower case, two characters at least."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "), " +"), lambda x: F.length(x) > 1)


# The shapes of a single identifier.
IDENTIFIER_SHAPES = ["^[a-z][a-z0-9]*(_[a-z0-9]+)+$", "^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)+$", "^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"]


def query_mode(query: Column) -> Column:
    """``keyword`` for one identifier in snake, Pascal or camel case, else ``hybrid``."""
    q = strip(query)
    shaped = F.lit(False)
    for shape in IDENTIFIER_SHAPES:
        shaped = shaped | q.rlike(shape)
    return F.when(shaped, "keyword").otherwise("hybrid")


def wants_tests(query: Column) -> Column:
    return F.lower(query).rlike(TEST_WORDS)


def shortened(doc: Column, size: int = 120) -> Column:
    """The text, or its start without trailing white space and an ellipsis."""
    return F.when(F.length(doc) > size, F.concat(strip_right(F.substring(doc, 1, size)), F.lit("…"))).otherwise(doc)


def round_even(x: Column, places: int) -> Column:
    """The nearest number of so many decimal places, by the exact value of the double; of two equally near the even one.

    The product with the power of ten and its rounding error are both exact (the
    factors' halves have 26 bits), so a double that only looks like a tie is none.
    Beyond 2^52 steps a double has no such decimals and stays.
    """
    scale = float(10**places)

    def halves(y: Column) -> tuple[Column, Column]:
        big = y * F.lit(134217729.0)
        high = big - (big - y)
        return high, y - high

    def rounded(y: Column) -> Column:
        (a, b), (c, d) = halves(y), halves(F.lit(scale))
        product = y * F.lit(scale)
        error = ((a * c - product) + a * d + b * c) + b * d
        low = F.floor(product)
        over = (product - low.cast("double") - F.lit(0.5)) + error
        up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2)) == 1))
        return F.when(F.abs(product) < F.lit(2.0**52), (low + up.cast("long")).cast("double") / F.lit(scale)).otherwise(y)

    return folds.bound(x.cast("double"), rounded)


def register(spark: SparkSession) -> None:
    """SQL names for the functions above; bodies are SQL, so they stay inside code generation."""
    spark.sql("create or replace temporary function node_id(f string, n string, l int) returns string return substr(md5(concat_ws('::', f, n, cast(l as string))), 1, 12)")
    spark.sql("create or replace temporary function content_hash(s string) returns string return substr(sha2(s, 256), 1, 16)")
    spark.sql("create or replace temporary function tfidf_tokens(t string) returns array<string> return filter(split(regexp_replace(lower(t), '[^a-z0-9]', ' '), ' +'), x -> length(x) > 1)")
    shaped = " or ".join(f"trim(q) rlike '{shape}'" for shape in IDENTIFIER_SHAPES)
    spark.sql(f"create or replace temporary function query_mode(q string) returns string return case when {shaped} then 'keyword' else 'hybrid' end")
