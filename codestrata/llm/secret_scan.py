"""Secret scans: credentials of one piece, and of several pieces that stand together.

Three kinds of spans are secrets by themselves (``BASE``). Parts of a credential
that are weak alone (an account's name, a key without a telling name, an
address) are reported only where complementary parts co-occur: an interval join
links identifiers to secrets, and linked identifiers to endpoints, within one
scope (a block of lines between blank lines) and at most ``REACH`` code points
apart. Spans of ``BASE`` take part in links (``access`` as an identifier,
``assign`` and ``hex`` as secrets); a weak part that overlaps one of them is
dropped, since it is reported already.

All of it is native: regular expressions give each text's matches and the
pieces between them, whose lengths add up to positions (running sums); spans
are then rows. A text is scanned once and only numbers are written
(``spark.checkpoint.dir``), so what is shuffled is a few rows a span, dealt by
the text's row. For the join, a span stands in each stretch of ``REACH`` code
points that it touches, an identifier also in the ones beside it; a pair meets in the
first common stretch only. A stretch holds a bounded number of parts, so pairs
grow with the text's length, not with its square.

Defined cases: null is the empty text, without spans; repeated rows are rows of
their own; positions are code points, ends exclusive; spans are sorted by start,
then kind in the order of ``KINDS``, then end. Only the id of the other columns
is returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.arrow import fresh
from codestrata.llm.scratch import Scratch

REACH = 400
LEAST_ASSIGNED = 6
BASE = ("assign", "access", "hex")
PARTS = ("identifier", "secret", "endpoint")
KINDS = (*BASE, *PARTS)

_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
# The patterns of BASE are fixed values. Where only matches of a least length count and shorter ones hide none, the length is in the pattern.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))" + _GIVEN + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{16,}|(?i:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id)" + _GIVEN + r"[A-Za-z0-9+/_.@-]{3,}"
SECRET = r"(?i:pwd|pass(?:phrase|code)?|(?:access|private|account|auth)_?key|credential|bearer)" + _GIVEN + r"[A-Za-z0-9+/_.=-]{8,}|[A-Za-z0-9+/]{40,}"
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\x09-\x0D\x20"'<>]+|(?i:host(?:_?name)?|endpoint|server|base_?url)""" + _GIVEN + r"[A-Za-z0-9_.:/-]{3,}"
BLANK = r"\n[\x20\t\r]*\n"
_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "secret": SECRET, "endpoint": ENDPOINT, "blank": BLANK}

_SPAN = "array<struct<kind:string,place:int,gap:int,size:int,good:boolean>>"


def _bare_key(hit: Column) -> Column:
    """Of the secrets without a name only those of 40 characters, of both cases and digits."""
    bare = hit.rlike("^[A-Za-z0-9+/]+$")
    return ~bare | ((F.length(hit) == 40) & hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]"))


def _matches(text: Column, kind: str, where: Column | None = None) -> Column:
    """The pattern's matches in order: the code points before each since the last one, and its own."""
    pattern = F.lit(_PATTERNS[kind])
    last = F.regexp_extract_all(text, pattern, 2) if kind == "assign" else F.array().cast("array<string>")
    found = F.struct(F.split(text, _PATTERNS[kind], -1).alias("pieces"), F.regexp_extract_all(text, pattern, 0).alias("hits"), last.alias("last"))

    def spans(s: Column) -> Column:
        def span(hit: Column, k: Column) -> Column:
            good = F.length(s["last"][k]) >= LEAST_ASSIGNED if kind == "assign" else _bare_key(hit) if kind == "secret" else F.lit(True)
            return F.struct(F.lit(kind).alias("kind"), k.alias("place"), F.length(s["pieces"][k]).alias("gap"), F.length(hit).alias("size"), good.alias("good"))

        return F.transform(s["hits"], span)

    some = text.rlike(_PATTERNS[kind]) if where is None else where
    # An array of one binds what is found, so that it is found once.
    return F.when(some, F.transform(F.array(found), spans)[0].cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _found(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A row a text: ``row``, ``i`` and the matches of all patterns; those of weak parts only where a link is possible."""
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_column].alias("i"), text.alias("t"))
    rows = rows.select("row", "i", "t", *[_matches(F.col("t"), k).alias(k) for k in BASE])
    some = {k: F.size(k) > 0 for k in BASE}
    named = some["access"] | F.col("t").rlike(IDENTIFIER)
    rows = rows.select("*", (named & (some["assign"] | some["hex"] | F.col("t").rlike(SECRET))).alias("linkable"))
    weak = [_matches(F.col("t"), k, F.col("linkable")).alias(k) for k in (*PARTS, "blank")]
    return rows.select("row", "i", F.concat(*BASE, *weak).alias("found"))


def _spans(found: DataFrame) -> DataFrame:
    """A row a span: ``row``, ``kind``, ``start``, ``end``, ``scope``; without weak parts that overlap a base span."""
    each = found.select("row", F.inline("found")).repartition("row")
    run = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(run)).where("good")
    each = each.select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    base = F.col("kind").isin(*BASE)
    order = Window.partitionBy("row").orderBy("start", F.when(base, 0).otherwise(1), "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    each = each.select(
        "*",
        F.coalesce(F.sum((F.col("kind") == "blank").cast("int")).over(before), F.lit(0)).alias("scope"),
        F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False)).alias("covered"),
        F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False)).alias("covers"),
    )
    return each.where((F.col("kind") != "blank") & (base | ~(F.col("covered") | F.col("covers")))).drop("covered", "covers")


def _role(spans: DataFrame, kinds: tuple[str, ...], side: str, margin: int) -> DataFrame:
    """Spans of these kinds, once for each stretch they touch; ``margin`` widens them."""
    first, last = F.floor((F.greatest(F.col("start") - margin, F.lit(0))) / REACH), F.floor((F.col("end") - 1 + margin) / REACH)
    chosen = spans.where(F.col("kind").isin(*kinds)).select(F.col("row").alias(f"{side}row"), F.col("scope").alias(f"{side}scope"), F.col("kind").alias(f"{side}kind"), F.col("start").alias(f"{side}start"), F.col("end").alias(f"{side}end"), first.alias(f"{side}first"), last.alias(f"{side}last"))
    return chosen.select("*", F.explode(F.sequence(f"{side}first", f"{side}last")).alias(f"{side}at"))


def _linked(identifiers: DataFrame, others: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Interval join: pairs of an identifier (``a``) and a span of ``kinds`` (``b``) in one scope, within reach, apart."""
    a, b = _role(identifiers, ("identifier", "access"), "a", REACH), _role(others, kinds, "b", 0)
    near = (F.col("bstart") >= F.col("aend")) & (F.col("bstart") - F.col("aend") <= REACH) | (F.col("astart") >= F.col("bend")) & (F.col("astart") - F.col("bend") <= REACH)
    meets = (F.col("arow") == F.col("brow")) & (F.col("ascope") == F.col("bscope")) & (F.col("aat") == F.col("bat")) & (F.col("aat") == F.greatest("afirst", "bfirst"))
    return a.join(b, meets & near)


def _side(links: DataFrame, side: str) -> DataFrame:
    return links.select(*[F.col(f"{side}{c}").alias(c) for c in ("row", "kind", "start", "end", "scope")])


def scan_secrets(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id and ``spans``: array of (kind, start, end), kinds as in ``KINDS``."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.table(_found(docs, id_column, text_column), "found")
    some = found.where(F.size("found") > 0)
    spans = scratch.table(_spans(some), "spans")
    links = scratch.table(_linked(spans, spans, ("secret", "assign", "hex")), "links")
    named = _side(links, "a").distinct()
    reported = [
        spans.where(F.col("kind").isin(*BASE)),
        named.where("kind = 'identifier'"),
        _side(links, "b").where("kind = 'secret'"),
        _side(_linked(named, spans, ("endpoint",)), "b"),
    ]
    every = reduce(DataFrame.unionByName, reported).select("row", "kind", "start", "end").distinct()
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    mine = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("sorted"))
    (name,) = fresh(docs.sparkSession.createDataFrame([], "spans int"), id_column)
    shown = F.transform(F.coalesce("sorted", F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    with_spans = some.select("row", "i").join(mine, "row", "left").select(F.col("i").alias(name), shown.alias("spans"))
    # Texts without any match need no join.
    none = found.where(F.size("found") == 0).select(F.col("i").alias(name), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("spans"))
    return with_spans.unionByName(none)
