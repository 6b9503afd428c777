"""Column builders with the reference's NaN, mask and division rules (Spark by itself has NaN = NaN and NaN above all numbers)."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sentinel of sky maps for "no value", and what a FLOAT column makes of it.
UNSEEN = -1.6375e30
UNSEEN_FLOAT = struct.unpack("f", struct.pack("f", UNSEEN))[0]
_INF = float("inf")


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (F.abs(d) < _INF)


def seen(c: Column) -> Column:
    """Finite and not the sentinel, in either width."""
    return finite(c) & ~c.cast("double").isin(UNSEEN, UNSEEN_FLOAT)


def all_finite(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & finite(c)
    return out


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparisons: everything with NaN is false, but != is true. Integers are compared as such, of any size."""
    nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    if op == "!=":
        return nan | (a != b)
    plain = {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return ~nan & plain


def divide(a: Column, b: Column, filler: float | None) -> Column:
    """a / b, and ``filler`` (None: NULL) where b is 0; never raises under ANSI."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(filler).cast("double"))
