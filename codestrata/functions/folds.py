"""Arrays folded inside a row: a state machine over a file's lines needs neither rows of its own nor a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that one inner fold takes: what it emits is copied at each step, so long arrays are folded in pieces.
PIECE = 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def scan(items: Column, start: Column, state: str, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], emitted: str) -> Column:
    """What ``emit(state, item)`` gives for each item, after ``step(state, item)`` has given the state with it.

    ``state`` and ``emitted`` are the types. Pieces of ``PIECE`` items are folded one
    after the other, so the work grows with the array and not with its square.
    """
    nothing = F.array().cast(f"array<{emitted}>")

    def one(held: Column, item: Column) -> Column:
        return bound(step(held["state"], item).cast(state), lambda new: F.struct(new.alias("state"), F.concat(held["out"], F.array(emit(new, item).cast(emitted))).alias("out")))

    def piece(held: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(held["state"].alias("state"), nothing.alias("out")), one)
        return bound(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(held["out"], F.array(r["out"])).alias("out")))

    def whole(given: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(given) - 1) / PIECE).cast("int")), lambda k: F.slice(given, k * PIECE + 1, F.lit(PIECE)))
        zero = F.struct(start.cast(state).alias("state"), F.array().cast(f"array<array<{emitted}>>").alias("out"))
        return F.when(F.size(given) > 0, F.flatten(F.aggregate(pieces, zero, piece)["out"])).otherwise(nothing)

    return bound(items, whole)
