"""Age bounds and the three-valued test against them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_bound(c: Column) -> Column:
    """A whole number from 0 that stands as a number or its text (``16.0`` too); else null."""
    t = F.trim(c.cast("string"))
    x = F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), t).try_cast("double")
    return F.when((F.floor(x) == x) & (x >= 0) & (x < 2147483648), x.cast("int"))


def strict_int(c: Column) -> Column:
    """A whole number's text and nothing else (``16.0`` is none); else null."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+$"), t).try_cast("int")


def age_status(low: Column, high: Column, age: Column) -> Column:
    """``unknown`` without bounds, ``no_match`` outside of them, else ``match``; null without an age."""
    return bound_status(age_bound(low), age_bound(high), age)


def bound_status(lo: Column, hi: Column, age: Column) -> Column:
    """:func:`age_status` of bounds that are whole numbers already."""
    known = F.when(lo.isNull() & hi.isNull(), "unknown").when((age < lo) | (age > hi), "no_match").otherwise("match")
    return F.when(age.isNotNull(), known)


def certainty(status: Column) -> Column:
    """The rank of a status: certain matches first."""
    return F.when(status == "match", 0).when(status == "unknown", 1).when(status == "no_match", 2).otherwise(3)
