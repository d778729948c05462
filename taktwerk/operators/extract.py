"""Document lines and cells to activity records.

``paragraphs`` is (source_file, n, text) and ``cells`` is (source_file, table_no, row_no, col_no, text); a document's
order is that of its positions.  Each layout is a chain of window and column operations, partitioned
by document, so a document is the unit that one task holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions.text import any_in, clean_text, squeezed
from taktwerk.functions.timeofday import add_minutes, canonical_day, canonical_time, status_of, time_range
from taktwerk.operators.ranking import running_total
from taktwerk.operators.rows import audience_by_name, duration_rules, infer_end, keep_first
from taktwerk.schemas import ACTIVITY
from taktwerk.sources.tables import merged, written

TIME = r"\d{1,2}[:.]\d{2}"
#: Header cells that are sent to all tasks.
SENT_HEADERS = 10_000


def _document(source: str = "source_file", place: str = "n"):
    return Window.partitionBy(source).orderBy(place)


def _so_far(source: str = "source_file", place: str = "n"):
    return _document(source, place).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def section(df: DataFrame, start: Column, end: Column | None = None, source: str = "source_file", place: str = "n") -> DataFrame:
    """The lines after the first start marker and before the first end marker behind it, without the markers."""
    w = _so_far(source, place)
    out = df.withColumn("_start", F.coalesce(start, F.lit(False)))
    out = out.withColumn("_inside", F.max(F.col("_start").cast("int")).over(w) == 1)
    stop = F.lit(False) if end is None else F.coalesce(end, F.lit(False)) & F.col("_inside")
    out = out.withColumn("_done", F.max(stop.cast("int")).over(w) == 1)
    return out.where(F.col("_inside") & ~F.col("_start") & ~F.col("_done")).drop("_start", "_inside", "_done")


def carried(df: DataFrame, is_header: Column, value: Column, into: str, source: str = "source_file", place: str = "n") -> DataFrame:
    """Each line gets the value of the last header at or before it; a header with a null value resets it."""
    return df.withColumn(into, F.last(F.when(is_header, F.struct(value.alias("v"))), ignorenulls=True).over(_so_far(source, place))["v"])


def following(df: DataFrame, value: Column, into: str, source: str = "source_file", place: str = "n") -> DataFrame:
    """Each line gets the value of the next line."""
    return df.withColumn(into, F.lead(value).over(_document(source, place)))


def computed(df: DataFrame, value: Column, into: str) -> DataFrame:
    """A column that is computed once for each row.

    A filter on a column that ``withColumn`` adds is moved before it and takes the whole expression along, once for every place that
    names it; what a generator puts out is only read.
    """
    return df.select("*", F.explode(F.array(value)).alias(into))


def with_title(paragraphs: DataFrame) -> DataFrame:
    """The document's first paragraph as ``center_name`` on each of its lines, texts trimmed."""
    out = paragraphs.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    return out.withColumn("center_name", F.first("text").over(_document()))


def by_day(df: DataFrame) -> DataFrame:
    """Lines below a day header, with its ``day``; headers themselves go."""
    header = rf"(?U)^{rules.DAY_PREFIX}\s+({'|'.join(rules.WEEKDAYS)})$"
    out = carried(df, F.col("text").rlike(header), F.regexp_extract("text", header, 1), "day")
    return out.where(F.col("day").isNotNull() & ~F.col("text").rlike(header))


def records(df: DataFrame, **columns: Column | str | None) -> DataFrame:
    """The activity schema (and ``n``, the place in the document); columns that are not named are null."""
    known = {f.name: F.col(f.name) for f in ACTIVITY if f.name in df.columns} | {k: F.lit(v) if v is None or isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ACTIVITY], F.col("n").cast("long").alias("n"))


def joined(parts: Column) -> Column:
    """Notes in one text; none is null."""
    return F.nullif(F.array_join(parts, " | "), F.lit(""))


def audience_from_notes(notes: Column) -> tuple[Column, Column]:
    """Audience, and what is left of the notes without the words for it."""
    mixed = F.coalesce(F.contains(notes, F.lit(rules.MIXED)), F.lit(False))
    rest = F.regexp_replace(F.replace(notes, F.lit(rules.MIXED), F.lit("")), r"^[ |,\-–]+|[ |,\-–]+$", "")
    return F.when(mixed, rules.MIXED).otherwise(rules.WOMEN), F.when(mixed, F.nullif(rest, F.lit(""))).otherwise(notes)


def basic(paragraphs: DataFrame) -> DataFrame:
    """Day headers, then ``start-end name – instructor – location (notes) – more notes``."""
    lines = by_day(section(with_title(paragraphs), F.col("text").isin(*rules.SECTION_START)))
    lines = lines.where(~F.col("text").isin(*rules.SECTION_LABELS))
    pattern = rf"(?U)^({TIME})\s*[-–]\s*({TIME})\s+(.+)$"
    x = [F.regexp_extract("text", pattern, k) for k in (1, 2, 3)]
    parts = F.filter(F.transform(F.split(F.trim(x[2]), r"(?U)\s+[–-]\s+"), lambda p: clean_text(p)), lambda p: p.isNotNull())
    lines = lines.where(F.col("text").rlike(pattern)).withColumn("raw_time", F.concat(x[0], F.lit("-"), x[1])).withColumn("p", parts).where(F.size("p") > 0)
    place, tail = F.get("p", F.lit(2)), r"(?U)^(.*?)\s*\((.+)\)$"
    bracket = F.when(place.rlike(tail), clean_text(F.regexp_extract(place, tail, 2)))
    location = F.when(place.rlike(tail), clean_text(F.regexp_extract(place, tail, 1))).otherwise(place)
    extra = F.when(F.size("p") > 3, F.slice("p", 4, F.greatest(F.size("p") - 3, F.lit(0))))
    lines = lines.withColumn("notes", clean_text(joined(F.array_compact(F.concat(F.array(bracket), F.coalesce(extra, F.array().cast("array<string>")))))))
    audience, notes = audience_from_notes(F.col("notes"))
    span = time_range(F.col("raw_time"))
    return records(
        lines, raw_day=F.col("day"), start_time=span["start"], end_time=span["end"], end_time_source="explicit", name=F.get("p", F.lit(0)), raw_name=F.get("p", F.lit(0)),
        instructor=F.get("p", F.lit(1)), location=location, target_audience=audience, notes=notes, status="active", source_language="he",
    )


def dirty_time(text: Column) -> Column:
    """Start, end and the rest of a line that begins with a range, an evening time or a single time."""
    gap = r"\s*[|,\-–]?\s*(.*)$"
    both, evening, single = rf"(?U)^({TIME})\s*[-–]\s*({TIME}){gap}", rf"(?U)^({TIME}\s*{rules.EVENING}){gap}", rf"(?U)^({TIME}){gap}"
    get = lambda p, k: F.regexp_extract(text, p, k)
    none = F.lit(None).cast("string")
    make = lambda a, b, c: F.struct(a.alias("start"), b.alias("end"), F.trim(c).alias("rest"))
    return (
        F.when(text.rlike(both), make(canonical_time(get(both, 1)), canonical_time(get(both, 2)), get(both, 3)))
        .when(text.rlike(evening), make(canonical_time(get(evening, 1)), none, get(evening, 2)))
        .when(text.rlike(single), make(canonical_time(get(single, 1)), none, get(single, 2)))
    )


def adaptive_parts(rest: Column) -> Column:
    """Cut at bars if there are any, else at commas, else at spaced dashes or wide gaps; empty parts go."""
    cut = F.when(F.contains(rest, F.lit("|")), F.split(rest, r"\|")).when(F.contains(rest, F.lit(",")), F.split(rest, ",")).otherwise(F.split(rest, r"(?U)\s+[–-]\s+|\s{2,}"))
    return F.filter(F.transform(cut, squeezed), lambda p: ~p.isin("", *rules.EMPTY_MARKS))


def dirty(paragraphs: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Lines with changing separators: name, instructor, location, notes by position.

    A part that says cancelled takes no position; a placeholder takes its position as null, and
    makes the row undecided where the instructor stands.  The last of these words sets the status.
    """
    lines = by_day(section(with_title(paragraphs), F.col("text").isin(*rules.SECTION_START))).where(~F.startswith("text", F.lit("*")))
    lines = computed(lines, dirty_time(F.col("text")), "t").where(F.col("t.start").isNotNull())
    lines = computed(lines, adaptive_parts(F.col("t.rest")), "p").where(F.size("p") > 0)
    tail = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    cancelled = lambda p: F.contains(p, F.lit(rules.CANCELLED))
    lines = lines.withColumn("r", F.filter(tail, lambda p: ~cancelled(p))).withColumn("tail", tail)
    # The place of the last cancelling part, and of the first part that takes a position.
    last_cancel = F.aggregate(F.transform("tail", lambda p, i: F.when(cancelled(p), i).otherwise(F.lit(-1))), F.lit(-1), lambda a, x: F.greatest(a, x))
    first_kept = F.aggregate(F.transform("tail", lambda p, i: F.when(cancelled(p), F.lit(1_000_000)).otherwise(i)), F.lit(1_000_000), lambda a, x: F.least(a, x))
    undecided = F.coalesce(F.get("r", F.lit(0)).isin(*rules.PLACEHOLDERS), F.lit(False))
    status = F.when(undecided & (first_kept > last_cancel), "tbd").when(last_cancel >= 0, "cancelled").when(undecided, "tbd").otherwise(status_of(F.col("t.rest")))
    notes = joined(F.slice("r", 3, F.greatest(F.size("r") - 2, F.lit(0))))
    name = F.get("p", F.lit(0))
    rows = records(
        lines, raw_day=F.col("day"), start_time=F.col("t.start"), end_time=F.col("t.end"), name=name, raw_name=name, instructor=clean_text(F.get("r", F.lit(0))),
        location=clean_text(F.get("r", F.lit(1))), target_audience=audience_by_name(clean_text(name), "dirty"), notes=notes, status=status, source_language="he",
    )
    rows = _ends(rows, durations)
    return keep_first(rows, ["source_file", "day", "start_time", "end_time", "name", "instructor", "location"], "n")


def _ends(rows: DataFrame, durations: DataFrame | None) -> DataFrame:
    found = infer_end(rows.drop("end_time_source"), durations if durations is not None else duration_rules(rows.sparkSession))
    return found.drop("end_time").withColumnRenamed("end_inferred", "end_time").select(*rows.columns)


def first_table(cells: DataFrame, words: list[str], lower: bool = False) -> DataFrame:
    """The cells of each document's first table whose header row holds all the words."""
    header = cells.where("row_no = 0").groupBy("source_file", "table_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]), " | ").alias("h"))
    h = F.lower("h") if lower else F.col("h")
    fits = reduce(lambda a, b: a & b, [F.contains(h, F.lit(w)) for w in words])
    chosen = header.where(fits).groupBy("source_file").agg(F.min("table_no").alias("table_no"))
    return merged(cells, chosen, ["source_file", "table_no"], "left_semi")


def unpivoted(grid: DataFrame) -> DataFrame:
    """A matrix's cells with the texts of their row's first cell and their column's header."""
    top = grid.where("row_no = 0").select("source_file", "table_no", "col_no", F.col("text").alias("column_head"))
    side = grid.where("col_no = 0 and row_no > 0").select("source_file", "table_no", "row_no", F.col("text").alias("row_head"))
    below = merged(grid.where("row_no > 0 and col_no > 0"), top, ["source_file", "table_no", "col_no"])
    return merged(below, side, ["source_file", "table_no", "row_no"])


def titles(paragraphs: DataFrame) -> DataFrame:
    """Each document's first paragraph."""
    return paragraphs.groupBy("source_file").agg(F.min_by("text", "n").alias("center_name"))


def matrix(paragraphs: DataFrame, cells: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Days across, times down; a cell's lines are name, instructor, location and notes."""
    grid = merged(unpivoted(first_table(cells, rules.TABLE_HEADER)), titles(paragraphs), "source_file")
    start = canonical_time(clean_text(F.col("row_head")))
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda p: clean_text(p)), lambda p: p.isNotNull())
    grid = grid.withColumn("start_time", start).where(F.col("start_time").isNotNull()).withColumn("p", lines).where(F.size("p") > 0)
    grid = grid.withColumn("n", F.col("row_no") * 10_000 + F.col("col_no"))
    notes = clean_text(joined(F.slice("p", 4, F.greatest(F.size("p") - 3, F.lit(0)))))
    audience, rest = audience_from_notes(notes)
    rows = records(
        grid, day=canonical_day(F.col("column_head")), raw_day=F.col("column_head"), raw_time=F.col("start_time"), name=F.get("p", F.lit(0)), raw_name=F.get("p", F.lit(0)),
        instructor=F.get("p", F.lit(1)), location=F.get("p", F.lit(2)), target_audience=audience, notes=rest, status="active", source_language="he",
    )
    return _ends(rows, durations)


def named_rows(grid: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per table row with its cells under the names that the header row's texts stand for; of equal headers the first counts.

    Headers go to the rows if they are few, as counted; many are merged.  Rows are dealt by their place first and put together
    then, so that no task sorts what a whole file holds.
    """
    top = grid.where("row_no = 0").select("source_file", "table_no", "col_no", clean_text(F.col("text")).alias("head"))
    few = top.limit(SENT_HEADERS + 1).count() <= SENT_HEADERS
    body = grid.where("row_no > 0").join(top.hint("broadcast" if few else "merge"), ["source_file", "table_no", "col_no"])
    row = ["source_file", "table_no", "row_no"]
    cell = lambda head: F.min_by("text", F.when(F.col("head") == head, F.col("col_no")))
    return body.repartition(*row).groupBy(*row).agg(*[cell(head).alias(name) for head, name in columns.items()])


def split_name(value: Column) -> Column:
    """Hebrew and English side of a name cut at its first slash; without a clear Hebrew side the right one leads."""
    name = clean_text(value)
    left, right = (F.trim(F.get(F.split(name, "/", 2), F.lit(k))) for k in (0, 1))
    hebrew = lambda c: c.rlike(r"[\x{0590}-\x{05FF}]")
    make = lambda a, b: F.struct(a.alias("he"), b.alias("en"))
    none = lambda c: F.nullif(c, F.lit(""))
    return (
        F.when(~F.contains(name, F.lit("/")), make(name, F.lit(None).cast("string")))
        .when(hebrew(left) & ~hebrew(right), make(left, right))
        .when(hebrew(right) & ~hebrew(left), make(right, left))
        .otherwise(make(F.coalesce(none(right), left), none(left)))
    )


def place_details(value: Column) -> Column:
    """Location, ages and note of a place with a bracket behind it; an age in it leaves no note."""
    place, tail = clean_text(value), r"(?U)^(.*?)\s*\((.+)\)\s*$"
    inner = F.when(place.rlike(tail), clean_text(F.regexp_extract(place, tail, 2)))
    number = lambda p, k: F.nullif(F.regexp_extract(inner, p, k), F.lit("")).cast("int")
    plus, span = r"(?i)Age\s*(\d+)\+", r"(?i)Age\s*(\d+)\s*[-–]\s*(\d+)"
    return F.struct(
        F.when(place.rlike(tail), clean_text(F.regexp_extract(place, tail, 1))).otherwise(place).alias("location"),
        F.coalesce(number(plus, 1), number(span, 1)).alias("min_age"),
        F.when(~inner.rlike(plus), number(span, 2)).alias("max_age"),
        F.when(~inner.rlike(plus) & ~inner.rlike(span), inner).alias("note"),
    )


def bilingual(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """A table with named columns; rows without a day, a start or a name go."""
    rows = merged(named_rows(first_table(cells, rules.BILINGUAL_HEADER, lower=True), rules.BILINGUAL_COLUMNS), titles(paragraphs), "source_file")
    rows = rows.dropna(subset=list(rules.BILINGUAL_COLUMNS.values()))
    rows = rows.withColumn("who", split_name(F.col("raw_name"))).withColumn("where", place_details(F.col("raw_room"))).withColumn("when", time_range(F.col("raw_time")))
    rows = rows.withColumn("day", canonical_day(F.col("raw_day"))).where(F.col("day").isNotNull() & F.col("when.start").isNotNull() & F.col("who.he").isNotNull())
    return records(
        rows.withColumn("n", F.col("row_no")), raw_day=clean_text(F.col("raw_day")), start_time=F.col("when.start"), end_time=F.col("when.end"), end_time_source="explicit",
        raw_time=clean_text(F.col("raw_time")), name=F.col("who.he"), raw_name=clean_text(F.col("raw_name")), english_name=F.col("who.en"),
        instructor=clean_text(F.col("raw_instructor")), location=F.col("where.location"), target_audience=audience_by_name(F.col("who.he"), "bilingual", F.col("where.min_age")),
        min_age=F.col("where.min_age"), max_age=F.col("where.max_age"), notes=F.col("where.note"), status="active", source_language="bilingual",
    )


def grouped(paragraphs: DataFrame) -> DataFrame:
    """Activity headings with labelled detail lines below; the last audience and the last level count."""
    lines = section(with_title(paragraphs), F.col("text").isin(*rules.GROUPED_START), F.startswith("text", F.lit(rules.GROUPED_END_PREFIX)))
    detail = F.startswith("text", F.lit(rules.DAYS_KEY))
    lines = carried(lines, ~detail, clean_text(F.col("text")), "name").where(detail & F.col("name").isNotNull())
    keys = (rules.DAYS_KEY, rules.HOUR_KEY, rules.INSTRUCTOR_KEY)
    pattern = "(?U)^" + r"\s*\|\s*".join(rf"{k}\s*(.*?)" for k in keys) + rf"\s*\|\s*{rules.ROOM_KEY}\s*(.*)$"
    raw = [clean_text(F.regexp_extract("text", pattern, k)) for k in (1, 2, 3, 4)]
    lines = lines.where(F.col("text").rlike(pattern)).select("*", raw[0].alias("raw_day"), raw[1].alias("raw_time"), raw[2].alias("instructor"), raw[3].alias("room"))
    lines = lines.where(F.col("raw_day").isNotNull() & F.col("raw_time").isNotNull())
    parts = F.filter(F.transform(F.split(F.coalesce("room", F.lit("")), r"\|"), lambda p: clean_text(p)), lambda p: p.isNotNull())
    lines = lines.withColumn("p", parts).withColumn("extra", F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))))
    audience = lambda p: p.isin(*rules.AUDIENCES)
    level = lambda p: F.startswith(p, F.lit(rules.LEVEL_PREFIX))
    last = lambda kept: F.try_element_at(kept, F.lit(-1))
    span = time_range(F.col("raw_time"))
    return records(
        lines, day=canonical_day(F.col("raw_day")), start_time=span["start"], end_time=span["end"], raw_name=F.col("name"), location=F.get("p", F.lit(0)),
        target_audience=last(F.filter("extra", audience)), level=F.trim(F.substring(last(F.filter("extra", lambda p: ~audience(p) & level(p))), len(rules.LEVEL_PREFIX) + 1, 1_000)),
        notes=joined(F.filter("extra", lambda p: ~audience(p) & ~level(p))), status="active", source_language="he",
    )


def ages_in(text: Column) -> tuple[Column, Column]:
    """The ages of a range, or the least age."""
    span, plus = r"(?U)גילאי\s*(\d+)\s*[-–]\s*(\d+)", r"(?U)גיל\s*(\d+)\+"
    number = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).cast("int")
    return F.coalesce(number(span, 1), number(plus, 1)), number(span, 2)


def capacity_in(text: Column) -> Column:
    """The most participants."""
    return F.nullif(F.regexp_extract(text, r"(?U)עד\s*(\d+)\s*משתת", 1), F.lit("")).cast("int")


def valid_from_in(text: Column) -> Column:
    """The first date as ISO text, whether the calendar has it or not."""
    p = r"מתחיל ב-(\d{1,2})\.(\d{1,2})\.(\d{4})"
    d, m, y = (F.regexp_extract(text, p, k) for k in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def season_in(text: Column) -> Column:
    """The first season whose words stand in the text."""
    return F.coalesce(*[F.when(any_in(text, words), F.lit(name)) for name, words in rules.SEASONS])


def branch_of(location: Column) -> Column:
    """Location and branch; the branch's words are cut out in their usual form only."""
    out = F.struct(location.alias("location"), F.lit(None).cast("string").alias("branch"))
    for b in reversed(rules.BRANCHES):
        words = f"{rules.BRANCH_WORD} {b}'"
        out = F.when(F.contains(location, F.lit(words)), F.struct(F.trim(F.replace(location, F.lit(f"– {words}"), F.lit(""))).alias("location"), F.lit(b).alias("branch"))).otherwise(out)
    return out


def labelled(text: Column, key: str) -> Column:
    """The cleaned value behind the last part of a line that begins with the key."""
    parts = F.filter(F.split(text, r"\|"), lambda p: F.startswith(squeezed(p), F.lit(key)))
    return clean_text(F.get(F.split(F.try_element_at(parts, F.lit(-1)), ":", 2), F.lit(1)))


def edge(paragraphs: DataFrame) -> DataFrame:
    """Time lines, each with a line of labelled details directly behind it if there is one."""
    all_lines = with_title(paragraphs)
    all_lines = following(all_lines, F.col("text"), "next")
    lines = by_day(section(all_lines, F.col("text").isin(*rules.EDGE_START), F.col("text") == rules.EDGE_END))
    pattern = rf"(?U)^({TIME})\s*[-–]\s*({TIME})\s+(.+)$"
    lines = lines.where(F.col("text").rlike(pattern)).withColumn("name", clean_text(F.regexp_extract("text", pattern, 3)))
    lines = lines.withColumn("meta", F.when(F.startswith("next", F.lit(rules.INSTRUCTOR_KEY)), F.col("next")))
    lines = lines.withColumn("raw_time", F.concat(F.regexp_extract("text", pattern, 1), F.lit("-"), F.regexp_extract("text", pattern, 2)))
    text = F.concat_ws(" | ", "name", "meta")
    lines = lines.withColumn("all", text)
    keys = (rules.INSTRUCTOR_KEY, rules.PLACE_KEY, rules.AUDIENCE_KEY)
    others = F.filter(F.transform(F.split("meta", r"\|"), lambda p: clean_text(p)), lambda p: p.isNotNull() & ~reduce(lambda a, b: a | b, [F.startswith(p, F.lit(k)) for k in keys]))
    flags = F.array_compact(F.array(*[F.when(F.contains("all", F.lit(words)), F.lit(flag)) for words, flag in rules.NOTE_FLAGS]))
    who = labelled(F.col("meta"), rules.INSTRUCTOR_KEY)
    names = F.array_join(F.filter(F.transform(F.split(who, "/"), lambda p: clean_text(p)), lambda p: p.isNotNull()), " / ")
    spot = branch_of(labelled(F.col("meta"), rules.PLACE_KEY))
    lo, hi = ages_in(F.col("all"))
    span = time_range(F.col("raw_time"))
    return records(
        lines, branch=spot["branch"], raw_day=F.col("day"), start_time=span["start"], end_time=span["end"], end_time_source="explicit", raw_name=F.col("name"),
        instructor=F.when(F.contains(who, F.lit("/")), F.coalesce(F.nullif(names, F.lit("")), who)).otherwise(who), location=spot["location"],
        target_audience=labelled(F.col("meta"), rules.AUDIENCE_KEY), min_age=lo, max_age=hi, capacity=capacity_in(F.col("all")), season=season_in(F.col("all")),
        valid_from=valid_from_in(F.col("all")), notes=joined(F.concat(F.coalesce(others, F.array().cast("array<string>")), flags)), status="active", source_language="he",
    )


#: Columns that make two extracted rows the same row of a document.
SAME_ROW = ["source_file", "day", "start_time", "end_time", "name", "instructor", "location"]


def ingest(paragraphs: DataFrame, cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """All documents by their layout (``source_file, layout``), one table with ``ord``, first of equal rows.

    The order is that of the file's name and the place in it: ``ord`` goes on from one file to the next.
    """
    def of(df: DataFrame, layout: str) -> DataFrame:
        return merged(df, layouts.where(F.col("layout") == layout).select("source_file"), "source_file", "left_semi")

    parts = [
        basic(of(paragraphs, "basic")), dirty(of(paragraphs, "dirty")), matrix(of(paragraphs, "table"), of(cells, "table")),
        bilingual(of(paragraphs, "bilingual"), of(cells, "bilingual")), grouped(of(paragraphs, "grouped")), edge(of(paragraphs, "edge")),
    ]
    table = written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "activities")
    place = F.struct("source_file", "n")
    first = table.withColumn("_place", place)
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy(*SAME_ROW).orderBy("_place"))).where("_k = 1").drop("_k", "_place")
    # One row per file.
    files = table.groupBy("source_file").agg((F.max("n") + 1).alias("_size"))
    files = running_total(files, ["source_file"], "_size", "_base").drop("_size")
    return merged(first, files, "source_file").withColumn("ord", (F.col("_base") + F.col("n")).cast("long")).drop("n", "_base")


def routed(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files that a manifest (``source_file, layout``) names, with their layout, and what does not fit: ``source_file, problem``.

    ``absent``: the manifest names a file that is not there; ``unrouted``: a file is there that it does not name.
    """
    named = files.withColumn("source_file", F.regexp_extract("path", "[^/]*$", 0))
    kept = merged(named, manifest.select("source_file", "layout"), "source_file")
    listed = named.select("source_file")
    absent = merged(manifest.select("source_file"), listed, "source_file", "left_anti").select("source_file", F.lit("absent").alias("problem"))
    unrouted = merged(listed, manifest.select("source_file"), "source_file", "left_anti").select("source_file", F.lit("unrouted").alias("problem"))
    return kept, absent.unionByName(unrouted)


def ingest_files(files: DataFrame, manifest: DataFrame, contents_of) -> tuple[DataFrame, DataFrame]:
    """All files of a manifest as one table (:func:`ingest`), and the files that do not fit it (:func:`routed`).

    Files (``path, content``) are opened once, by ``contents_of`` (see :func:`taktwerk.sources.documents.contents`).
    """
    kept, problems = routed(files, manifest)
    both = written(contents_of(kept.select("path", "content")), "contents")
    paragraphs = both.where("n IS NOT NULL").select("source_file", "n", "text")
    cells = both.where("n IS NULL").select("source_file", "table_no", "row_no", "col_no", "text")
    return ingest(paragraphs, cells, manifest.select("source_file", "layout")), problems


__all__ = ["adaptive_parts", "add_minutes", "basic", "bilingual", "carried", "dirty", "edge", "following", "grouped", "ingest", "ingest_files", "matrix", "routed", "section", "unpivoted"]
