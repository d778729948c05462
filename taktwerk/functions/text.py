"""Text columns: cleaning, search form, tolerant comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taktwerk.functions import rules

SPACE = r"(?U)\s+"


def squeezed(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_text(c: Column, placeholders: list[str] | None = None) -> Column:
    """Squeezed; blank, a lone dash or a placeholder becomes null."""
    gone = rules.EMPTY_MARKS + (rules.PLACEHOLDERS if placeholders is None else placeholders)
    s = squeezed(c)
    return F.when(s.isin("", *gone), F.lit(None)).otherwise(s)


def nullified(c: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def is_blank(c: Column) -> Column:
    """Whether a value is null or white space only."""
    return c.isNull() | (squeezed(c.cast("string")) == "")


def search_form(c: Column) -> Column:
    """Lower case, squeezed; null becomes empty."""
    return F.coalesce(F.lower(squeezed(c.cast("string"))), F.lit(""))


def tolerant_match(value: Column, wanted: Column) -> Column:
    """Whether either holds the other in search form.

    Nothing wanted (null) matches all; a null value matches nothing else, while a blank wanted
    text matches every value and a blank value every wanted text.
    """
    v, w = search_form(value), search_form(wanted)
    return F.when(wanted.isNull(), F.lit(True)).when(value.isNull(), F.lit(False)).otherwise(F.contains(v, w) | F.contains(w, v))


def form_match(value: Column, wanted: Column) -> Column:
    """:func:`tolerant_match` of texts that are in search form already, or null."""
    return F.when(wanted.isNull(), F.lit(True)).when(value.isNull(), F.lit(False)).otherwise(F.contains(value, wanted) | F.contains(wanted, value))


def any_in(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def word_in(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words by itself."""
    return text.rlike(rf"(?U)\b(?:{'|'.join(words)})\b")


def edge_stripped(c: Column, marks: str = rules.EDGE_PUNCTUATION) -> Column:
    """Without the marks at both ends."""
    group = "[" + "".join(f"\\{m}" if m in "?!.,:;\"'" else m for m in marks) + "]+"
    return F.regexp_replace(c, f"^{group}|{group}$", "")


def symbol_only(c: Column) -> Column:
    """Whether a message has neither letter nor digit."""
    return ~F.coalesce(c, F.lit("")).rlike(r"[\p{L}\p{N}]")


def center_reference(c: Column) -> Column:
    """A centre's name for comparison: without quotes and without one of the usual first words."""
    plain = squeezed(F.regexp_replace(F.lower(c), "[\"'׳״]", ""))
    return F.trim(F.regexp_replace(plain, "^(?:" + "|".join(rules.CENTER_PREFIXES) + r")\s*", ""))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's value for the text, or the text itself."""
    if not table:
        return c
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(pairs[c], c)


def unified_location(c: Column) -> Column:
    """Dashes as one kind, squeezed; blank becomes null."""
    return F.nullif(squeezed(F.replace(c, F.lit("-"), F.lit("–"))), F.lit(""))


def combined_location(location: Column, branch: Column) -> Column:
    """Location and branch in one text; null without a location."""
    place = unified_location(location)
    return F.when(nullified(branch).isNull(), place).otherwise(unified_location(F.concat(place, F.lit(f" – {rules.BRANCH_WORD} "), nullified(branch), F.lit("'"))))


def locations_match(wanted: Column, location: Column, branch: Column) -> Column:
    """Whether the wanted location is the combined one or the plain one; null equals null."""
    w = unified_location(wanted)
    return w.eqNullSafe(combined_location(location, branch)) | w.eqNullSafe(unified_location(location))


def unified_audience(c: Column) -> Column:
    return mapped(F.trim(c), rules.AUDIENCE_ALIASES)


def holds(text: Column, part: Column) -> Column:
    """Case-insensitive containment; null counts as empty."""
    return F.contains(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lower(F.trim(F.coalesce(part, F.lit("")))))
