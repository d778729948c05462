"""Filters carried over a conversation, as windows over its turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions.text import any_in, edge_stripped, squeezed, symbol_only


def _normal(c: Column) -> Column:
    return F.lower(squeezed(F.coalesce(c, F.lit(""))))


def thanks_or_stop(text: Column, signals: list[str] | None = None) -> Column:
    return any_in(_normal(text), signals or rules.STOP_SIGNALS + rules.THANKS_SIGNALS)


def label(text: Column) -> Column:
    """``symbols``, ``greeting``, ``thanks``, ``stop`` or ``message``."""
    n = edge_stripped(_normal(text))
    return (
        F.when(symbol_only(text), "symbols").when(n.isin(*rules.GREETINGS), "greeting").when(n.isin(*rules.THANKS), "thanks").when(thanks_or_stop(text), "stop").otherwise("message")
    )


def wants_more(text: Column) -> Column:
    """Whether an answer asks for the next page."""
    n = edge_stripped(_normal(text))
    return n.isin(*rules.MORE_ANSWERS) | (F.contains(n, F.lit(rules.MORE)) & ~F.startswith(n, F.lit(rules.NO)))


def wants_no_more(text: Column) -> Column:
    """Whether an answer ends the paging."""
    n = edge_stripped(_normal(text))
    return F.startswith(n, F.lit(rules.NO)) | any_in(n, [rules.ENOUGH, rules.NO_NEED]) | thanks_or_stop(n)


def cleared_fields(text: Column, phrases: list[tuple[str, list[str]]] | None = None) -> Column:
    """The fields that a message clears, each once, in a fixed order."""
    n = _normal(text)
    return F.array_compact(F.array(*[F.when(any_in(n, words), F.lit(name)) for name, words in phrases or rules.CLEAR_PHRASES]))


def completed(fragment: Column) -> Column:
    """A fragment as a whole question, unless it already is one."""
    f = F.trim(fragment)
    return F.when((f == "") | any_in(_normal(f), rules.COMPLETE_QUERY_SIGNALS), f).otherwise(F.concat(F.lit(rules.QUERY_FRAME[0]), f, F.lit(rules.QUERY_FRAME[1])))


def may_follow_up(text: Column, has_previous: Column, signals: list[str] | None = None, words: int = 6) -> Column:
    """Whether a message may continue the previous search: it has a signal or few words."""
    n = _normal(text)
    few = F.size(F.filter(F.split(n, " "), lambda w: w != "")) <= words
    return F.coalesce(has_previous, F.lit(False)) & (any_in(n, signals or rules.FOLLOW_UP_SIGNALS) | few)


def carried_state(turns: DataFrame, slots: list[str], conv: str = "conv_id", turn: str = "turn", new_query: Column | None = None, cleared: Column | None = None) -> DataFrame:
    """The filters in force at every turn.

    ``turns`` has each turn's own slots.  A new query drops all that was before; a turn clears its
    ``cleared`` fields and then sets its own values; a slot without a value keeps the last one.
    ``start_after`` and ``start_before`` are one pair: either one set replaces both, and the field
    ``time`` clears both.
    """
    clear = F.coalesce(cleared, F.array().cast("array<string>")) if cleared is not None else F.array().cast("array<string>")
    out = turns.withColumn("_clear", clear)
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.lit(0) if new_query is None else F.coalesce(new_query, F.lit(False)).cast("int")
    out = out.withColumn("_epoch", F.sum(start).over(w))
    e = Window.partitionBy(conv, "_epoch").orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pair = [s for s in ("start_after", "start_before") if s in slots]
    shown = {}
    for s in slots:
        if s in pair:
            mine, name = F.coalesce(*[F.col(p).cast("string") for p in pair]).isNotNull(), "time"
        else:
            mine, name = F.col(s).isNotNull(), s
        gone = F.array_contains("_clear", name) | F.array_contains("_clear", s)
        shown[s] = F.last(F.when(mine | gone, F.struct(F.col(s).alias("v"))), ignorenulls=True).over(e)["v"]
    return out.withColumns({f"now_{s}": c for s, c in shown.items()}).drop("_clear", "_epoch")


def sessions(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", page: int = 5) -> DataFrame:
    """Paging over a conversation: ``turns`` has ``label``, ``more``, ``new_query`` and ``results`` (rows found).

    A new query arms the paging if it found more than a page; thanks, stop or another message resets
    it; each request for more moves the offset.  Adds ``offset``, ``page_rows`` and ``has_more``.
    """
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    resets = F.col("new_query") | ~F.col("more") | F.col("label").isin("thanks", "stop")
    out = turns.withColumn("_resets", resets).withColumn("_part", F.sum(resets.cast("int")).over(w))
    e = Window.partitionBy(conv, "_part").orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.first(F.when(F.col("new_query"), F.col("results")).otherwise(F.lit(0))).over(e)
    pages = F.sum((~F.col("_resets")).cast("int")).over(e)
    out = out.withColumn("_found", found).withColumn("offset", F.least(pages * page, F.col("_found")).cast("long"))
    out = out.withColumn("page_rows", F.greatest(F.lit(0), F.least(F.lit(page), F.col("_found") - F.col("offset"))).cast("long"))
    return out.withColumn("has_more", F.col("_found") > F.col("offset") + page).drop("_resets", "_part", "_found")


def known_slots(slots: list[str]) -> Column:
    """The names of the slots that are set, in order."""
    return F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in slots]))


def context_text(slots: dict[str, Column]) -> Column:
    """The filters that are set as lines, for display."""
    return F.concat_ws("\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in slots.items()])


def request_text(slots: dict[str, Column]) -> Column:
    """The filters in force as one request, for display: search itself takes the columns."""
    after, before = (slots.get(s, F.lit(None).cast("string")) for s in ("start_after", "start_before"))
    times = F.when(after == before, F.concat(F.lit(f"{rules.AT_HOUR} "), after)).otherwise(
        F.concat_ws(" ", F.when(after.isNotNull(), F.concat(F.lit(f"{rules.AFTER} "), after)), F.when(before.isNotNull(), F.concat(F.lit(f"{rules.BEFORE} "), before)))
    )
    rest = [c.cast("string") for name, c in slots.items() if name not in ("start_after", "start_before")]
    return F.concat(F.lit(rules.QUERY_FRAME[0]), F.trim(F.concat_ws(" ", *rest, F.nullif(times, F.lit("")))), F.lit(rules.QUERY_FRAME[1]))
