"""Rules over a message table: from a text and candidate slots to cleaned slots.

``messages`` has ``text``, ``msg_date`` and the candidate slots as nullable columns (``intent``,
``confident``, ``day``, ``start_after``, ``start_before``, ``target_audience``, ``center_name``, ``location``,
``branch``, ``instructor``, ...).  The word lists are parameters with Hebrew defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions.text import any_in, center_reference, squeezed, word_in
from taktwerk.functions.timeofday import clock_after, valid_clock, weekday_of

SLOTS = ["category", "age", "target_audience", "day", "start_after", "start_before", "location", "center_name", "branch", "instructor"]


@dataclass(frozen=True)
class Words:
    """The words that the rules look for."""

    activity: list[str] = field(default_factory=lambda: rules.ACTIVITY_WORDS)
    vague: list[str] = field(default_factory=lambda: rules.VAGUE_OPENERS)
    generic: list[str] = field(default_factory=lambda: rules.GENERIC_OPENERS)
    clues: list[str] = field(default_factory=lambda: rules.CLUES)
    relative: tuple[str, str, str] = (rules.TODAY, rules.TOMORROW, rules.YESTERDAY)
    weekdays: list[str] = field(default_factory=lambda: rules.WEEKDAYS)
    day_variants: dict[str, list[str]] = field(default_factory=lambda: {d: rules.DAY_VARIANTS.get(d, [d]) for d in rules.WEEKDAYS})
    at: list[str] = field(default_factory=lambda: [rules.AT_HOUR, rules.AT_PREFIX])
    after: str = rules.AFTER
    before: str = rules.BEFORE
    dayparts: list[tuple[str, list[str], list[str]]] = field(default_factory=lambda: rules.DAYPART_WORDS)
    audiences: list[tuple[str, list[str]]] = field(default_factory=lambda: rules.AUDIENCE_WORDS)
    no_centers: list[str] = field(default_factory=lambda: rules.NO_CENTERS)
    branch: str = rules.BRANCH_WORD


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _opens(text: Column, openers: list[str]) -> Column:
    return text.rlike(rf"(?U)^(?:{'|'.join(openers)})\b")


def intent(text: Column, candidate: Column, confident: Column, w: Words) -> Column:
    """Intent and confidence: an activity word decides; else a vague opener makes it unknown; else
    a general opener with a clue makes it an activity; else the candidate stays."""
    t = _plain(text)
    clean = squeezed(F.regexp_replace(t, r"[?!.,:;׳״\"'…]+", " "))
    make = lambda i, c: F.struct(i.alias("intent"), c.alias("confident"))
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(any_in(t, w.activity), make(F.lit("activity"), yes))
        .when(_opens(t, w.vague), make(F.lit("unknown"), no))
        .when(_opens(clean, w.generic) & any_in(clean, w.clues), make(F.lit("activity"), yes))
        .otherwise(make(candidate, confident))
    )


def relative_day(text: Column, date: Column, candidate: Column, w: Words) -> Column:
    """The weekday of today, tomorrow or yesterday, counted from the message's date; else the candidate."""
    t = _plain(text)
    today, tomorrow, yesterday = w.relative
    return (
        F.when(word_in(t, [today]), weekday_of(date, w.weekdays))
        .when(word_in(t, [tomorrow]), weekday_of(F.date_add(date, 1), w.weekdays))
        .when(word_in(t, [yesterday]), weekday_of(F.date_sub(date, 1), w.weekdays))
        .otherwise(candidate)
    )


def time_bounds(text: Column, after: Column, before: Column, w: Words) -> Column:
    """The pair of bounds: an exact time; else after and before (a side that is missing or invalid is
    null); else the first daypart; else the candidates where they are valid."""
    t = _plain(text)
    make = lambda a, b: F.struct(a.alias("start_after"), b.alias("start_before"))
    hm = r"\s*\d{1,2}:\d{2}"
    exact = F.coalesce(*[clock_after(t, word) for word in w.at])
    out = F.when(exact.isNotNull(), make(exact, exact))
    out = out.when(t.rlike(w.after + hm) | t.rlike(w.before + hm), make(clock_after(t, w.after), clock_after(t, w.before)))
    bounds = {label: (F.lit(lo), F.lit(hi)) for label, lo, hi in rules.DAYPARTS}
    for label, anywhere, alone in w.dayparts:
        out = out.when(any_in(t, anywhere) | word_in(t, alone), make(*bounds[label]))
    return out.otherwise(make(valid_clock(after), valid_clock(before)))


def audience(text: Column, candidate: Column, w: Words) -> Column:
    """The first audience whose words stand in the text; else the candidate."""
    t = _plain(text)
    out = candidate
    for label, words in reversed(w.audiences):
        out = F.when(any_in(t, words), F.lit(label)).otherwise(out)
    return out


def center(text: Column, candidate: Column, w: Words) -> Column:
    """The centre, unless it is a word for a time or day or does not stand in the text."""
    c = _plain(candidate)
    return F.when(~c.isin(*w.no_centers) & ((c == "") | F.contains(_plain(text), c)), candidate)


def location(candidate: Column, center_name: Column) -> Column:
    """The location, unless it is the centre by another name."""
    same = (center_reference(candidate) == center_reference(center_name)) & (center_reference(candidate) != "")
    return F.when(~F.coalesce(same, F.lit(False)), candidate)


def mentioned(text: Column, candidate: Column) -> Column:
    """The candidate if it stands in the text."""
    return F.when(F.contains(_plain(text), _plain(candidate)), candidate)


def branch(text: Column, candidate: Column, w: Words) -> Column:
    """The branch if the text names it, with a blank behind the word or without."""
    t, b = _plain(text), _plain(candidate)
    return F.when(F.contains(t, F.concat(F.lit(f"{w.branch} "), b)) | F.contains(t, F.concat(F.lit(w.branch), b)), candidate)


def evident_day(text: Column, day: Column, w: Words) -> Column:
    """The day if the text has a relative word or one of the day's spellings."""
    t = _plain(text)
    ok = any_in(t, list(w.relative))
    for name, variants in w.day_variants.items():
        ok = ok | ((day == name) & any_in(t, variants))
    return F.when(ok, day)


def understand(messages: DataFrame, words: Words | None = None) -> DataFrame:
    """All rules in their order; the slots are replaced, other columns stay."""
    w = words or Words()
    have = set(messages.columns)
    get = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = messages.withColumn("_intent", intent(text, get("intent"), get("confident", "boolean"), w)).withColumn("_time", time_bounds(text, get("start_after"), get("start_before"), w))
    kept_center = F.when(~F.coalesce(_plain(get("center_name")).isin(*w.no_centers), F.lit(False)), get("center_name"))
    return out.select(
        *[c for c in messages.columns if c not in {"intent", "confident", *SLOTS}],
        F.col("_intent.intent").alias("intent"), F.col("_intent.confident").alias("confident"), get("category").alias("category"), get("age", "int").alias("age"),
        audience(text, get("target_audience"), w).alias("target_audience"), evident_day(text, relative_day(text, F.col("msg_date"), get("day"), w), w).alias("day"),
        F.col("_time.start_after").alias("start_after"), F.col("_time.start_before").alias("start_before"), location(get("location"), kept_center).alias("location"),
        center(text, get("center_name"), w).alias("center_name"), branch(text, get("branch"), w).alias("branch"), mentioned(text, get("instructor")).alias("instructor"),
    )


def filled(first: DataFrame, second: DataFrame, key: str, slots: list[str]) -> DataFrame:
    """Per slot the second reading's value, or the first's where the second has none."""
    s = second.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in slots])
    out = first.join(s, first[key] == F.col("_k"), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in slots else F.col(c) for c in first.columns])


def route(text: Column, intent_: Column, confident: Column, waiting: Column, after_fallback: Column) -> Column:
    """Where a message goes: clarify, search or fallback."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    wants = F.coalesce(intent_ == "activity", F.lit(False))
    return (
        F.when(blank | F.coalesce(waiting, F.lit(False)), "clarify")
        .when(F.coalesce(after_fallback, F.lit(False)), F.when(wants, "search").otherwise("clarify"))
        .when(wants & F.coalesce(confident, F.lit(False)), "search")
        .otherwise("fallback")
    )


def lexicon_slots(messages: DataFrame, key: list[str], lexicon: DataFrame, near: bool = False) -> DataFrame:
    """Candidate slots from a lexicon (``slot, variant, canonical``): per message and slot the canonical
    value of the longest variant whose words the text has in a row; with ``near`` also one letter off.

    Words in a row, as many as some variant has, are exploded and met with the variants by equality; one-letter
    misses go by the variant with one letter left out, so that no pair of all words and variants is formed.  The lexicon is a
    table of any size, of which only the numbers of words that occur are asked for first; see also :mod:`taktwerk.operators.lexicon`.
    """
    words = lambda c: F.filter(F.split(squeezed(F.lower(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    lex = lexicon.select("slot", "canonical", F.array_join(words(F.col("variant")), " ").alias("variant"), F.size(words(F.col("variant"))).alias("n")).where("n > 0")
    lengths = {r.n for r in lex.select("n").distinct().collect()} or {1}
    # One letter off may also be the blank between two words.
    lengths |= {n + step for n in lengths for step in (-1, 1) if n + step > 0} if near else set()
    own = messages.select(*key, words(F.col("text")).alias("words"))
    in_a_row = lambda k: F.transform("words", lambda w, i: F.when(i + k <= F.size("words"), F.array_join(F.slice("words", i + 1, F.lit(k)), " ")))
    tokens = own.select(*key, F.explode(F.array_distinct(F.concat(*[in_a_row(k) for k in sorted(lengths)]))).alias("token")).where("token IS NOT NULL")
    lex = lex.drop("n")
    if near:
        cut = lambda c: F.explode(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
        pairs = tokens.withColumn("part", cut(F.col("token"))).join(lex.withColumn("part", cut(F.col("variant"))), "part")
        hits = pairs.where(F.levenshtein("token", "variant") <= 1)
    else:
        hits = tokens.join(lex, F.col("token") == F.col("variant"))
    best = F.max_by("canonical", F.struct(-F.levenshtein("token", "variant"), F.length("variant"), "variant"))
    return hits.groupBy(*key, "slot").agg(best.alias("canonical"))
