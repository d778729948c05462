"""Weekdays and times of day, kept as ``HH:mm`` texts and compared as seconds of the day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions.text import any_in, clean_text, mapped


def _number(c: Column) -> Column:
    """A text as a whole number, or null.  An empty one is null before the cast, which raises and catches an error for each it cannot read."""
    return F.nullif(c, F.lit("")).try_cast("int")


def _part(c: Column, pattern: str, group: int) -> Column:
    return _number(F.regexp_extract(c, pattern, group))


def _clock(hour: Column, minute: Column) -> Column:
    return F.when(hour.isNotNull() & minute.isNotNull(), F.format_string("%02d:%02d", hour, minute))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def day_table() -> dict[str, str]:
    """Spellings of the weekdays and the one kept: bare, with the word for day, and English."""
    out = {}
    for day, english in zip(rules.WEEKDAYS, rules.ENGLISH_WEEKDAYS, strict=True):
        out |= {day: day, f"{rules.DAY_PREFIX} {day}": day, english: day}
    return out


def canonical_day(c: Column) -> Column:
    """The weekday of a known spelling; other texts stay."""
    return mapped(clean_text(c), day_table())


def canonical_time(c: Column) -> Column:
    """``HH:mm`` of a time with the word for evening, with AM or PM, or bare, the first that applies.

    The evening and AM/PM forms are not range-checked; a bare one must stand apart from other
    digits and lie within the day.
    """
    hm = r"(\d{1,2})[:.](\d{2})"
    half = hm + r"\s*(?i:(AM|PM))"
    bare = r"(?<!\d)(\d{1,2})[:.](\d{2})(?!\d)"

    def of(t: Column) -> Column:
        eh, em = _part(t, hm, 1), _part(t, hm, 2)
        ph, pm, period = _part(t, half, 1), _part(t, half, 2), F.upper(F.regexp_extract(t, half, 3))
        bh, bm = _part(t, bare, 1), _part(t, bare, 2)
        return (
            F.when(F.contains(t, F.lit(rules.EVENING)) & eh.isNotNull(), _clock(F.when(eh < 12, eh + 12).otherwise(eh), em))
            .when(ph.isNotNull(), _clock(F.when((period == "AM") & (ph == 12), 0).when((period == "PM") & (ph != 12), ph + 12).otherwise(ph), pm))
            .when((bh <= 23) & (bm <= 59), _clock(bh, bm))
        )

    return _let(clean_text(c), of)


def time_range(c: Column) -> Column:
    """Start and end of a range cut at its first dash; a single time has no end."""
    parts = F.split(clean_text(c), r"\s*[-–]\s*", 2)
    return _let(parts, lambda p: F.struct(canonical_time(F.get(p, F.lit(0))).alias("start"), canonical_time(F.get(p, F.lit(1))).alias("end")))


def _stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def seconds_of(c: Column) -> Column:
    """Seconds of the day of ``H:M``, ``H:M:S``, a timestamp's text, or a text that begins with a time; else null."""
    head = r"^(?:\d{4}-\d{2}-\d{2}[ T])?(\d{1,2}:\d{1,2}(?::\d{1,2})?)"

    def of(parts: Column) -> Column:
        h, m = (_number(F.get(parts, F.lit(k))) for k in (0, 1))
        s = F.coalesce(_number(F.get(parts, F.lit(2))), F.lit(0))
        return F.when((h <= 23) & (m <= 59) & (s <= 59), h * 3600 + m * 60 + s)

    return _let(F.split(F.regexp_extract(_stripped(c), head, 1), ":"), of)


def strict_seconds(c: Column) -> Column:
    """Seconds of the day of exactly ``H:M`` or ``H:M:S``; else null."""
    t = _stripped(c)
    return F.when(t.rlike(r"^\d{1,2}:\d{1,2}(:\d{1,2})?$"), seconds_of(t))


def valid_clock(c: Column) -> Column:
    """``HH:mm`` of exactly ``h:mm`` within the day; else null."""
    t = _stripped(c)
    h, m = _part(t, r"^(\d{1,2}):(\d{2})$", 1), _part(t, r"^(\d{1,2}):(\d{2})$", 2)
    return F.when((h <= 23) & (m <= 59), _clock(h, m))


def clock_after(c: Column, pattern: str) -> Column:
    """``HH:mm`` of the first time that follows the pattern; null if there is none or it is out of range."""
    full = pattern + r"\s*(\d{1,2}):(\d{2})"
    h, m = _part(c, full, 1), _part(c, full, 2)
    return F.when((h <= 23) & (m <= 59), _clock(h, m))


def add_minutes(start: Column, minutes: Column) -> Column:
    """The time so many minutes later, past midnight again from 00:00; null for a bad start."""
    h, m = _part(start, r"^(\d{1,2}):(\d{1,2})$", 1), _part(start, r"^(\d{1,2}):(\d{1,2})$", 2)
    total = F.pmod(h * 60 + m + minutes.cast("int"), F.lit(1440))
    return F.when((h <= 23) & (m <= 59), _clock(F.floor(total / 60).cast("int"), (total % 60).cast("int")))


def weekday_of(date: Column, names: list[str] | None = None) -> Column:
    """A date's weekday by name, the week beginning on Sunday."""
    return F.element_at(F.array(*[F.lit(n) for n in names or rules.WEEKDAYS]), F.dayofweek(date))


def at_or_after(value: Column, bound: Column) -> Column:
    """Whether a time is not before the bound; false if either is none."""
    return F.coalesce(seconds_of(value) >= seconds_of(bound), F.lit(False))


def at_or_before(value: Column, bound: Column) -> Column:
    """Whether a time is not after the bound; false if either is none."""
    return F.coalesce(seconds_of(value) <= seconds_of(bound), F.lit(False))


def status_of(c: Column) -> Column:
    """``cancelled``, ``tbd`` or ``active`` by the words in a text; empty is active."""

    def of(t: Column) -> Column:
        return F.when(any_in(t, [rules.CANCELLED, "cancelled"]), "cancelled").when(any_in(t, rules.PLACEHOLDERS), "tbd").otherwise("active")

    return _let(F.lower(F.coalesce(c, F.lit(""))), of)
