"""Documents, messages and cases built from the given tables, read by the layouts, fields and checks; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.functions import text as tx
from taktwerk.functions import timeofday as td
from taktwerk.operators import conversation, evalcases, extract, quality, rows
from taktwerk.sources import documents


def _columns() -> list[Column]:
    return [F.col(c) for c in ("p_size", "p_name", "p_brand", "p_type")]


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet")


def _choice(of: Column, *values: Column | str | None) -> Column:
    """The value whose place is ``of``."""
    out = F.lit(None).cast("string")
    for k, v in reversed(list(enumerate(values))):
        out = F.when(of == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _paragraphs(spark: SparkSession, sf: str, *lines: Column) -> DataFrame:
    """A document of these lines for every part; parts are dealt by document first, as their table may be one file."""
    parts = _parts(spark, sf).withColumn("source_file", F.col("p_partkey").cast("string")).repartition("source_file")
    return parts.select("source_file", F.posexplode(F.array_compact(F.array(*lines))).alias("n", "text"))


def _shown(table: DataFrame, *columns: str) -> DataFrame:
    return table.select(F.col("source_file").cast("long").alias("p_partkey"), *columns)


def basic_lines() -> list[Column]:
    n, name, brand, kind = _columns()
    tail = F.when(n % 2 == 0, F.lit(f" ({rules.MIXED}) – extra")).otherwise("")
    time = F.format_string("%d:%02d - 23.59 ", n % 24, n % 60)
    return [F.concat(F.lit("  "), name), F.lit("9:00-10:00 early"), F.lit(rules.SECTION_START[1]), F.lit("יום שני"), F.concat(time, name, F.lit(" – "), brand, F.lit(" - "), kind, tail), F.lit("no time")]


def layout_basic(spark, sf):
    return _shown(extract.basic(_paragraphs(spark, sf, *basic_lines())), "center_name", "day", "start_time", "end_time", "name", "instructor", "location", "target_audience", "notes")


def dirty_lines() -> list[Column]:
    n, name, brand, kind = _columns()
    line = _choice(
        n % 3, F.concat(F.lit("9.15 | "), name, F.lit(" | "), brand, F.lit(" | "), kind), F.concat(F.lit("18:00-19:00, "), name, F.lit(", "), brand, F.lit(f", {rules.CANCELLED}")),
        F.concat(F.lit(f"8:00 {rules.EVENING} - "), name, F.lit(" - "), F.lit(rules.PLACEHOLDERS[1])),
    )
    return [name, F.lit(rules.SECTION_START[1]), F.lit("יום חמישי"), line, F.lit("* 10:00 remark"), line]


def layout_dirty(spark, sf):
    return _shown(extract.dirty(_paragraphs(spark, sf, *dirty_lines())), "day", "start_time", "end_time", "end_time_source", "name", "instructor", "location", "status")


def grouped_lines() -> list[Column]:
    n, name, brand, kind = _columns()
    detail = F.concat(F.lit("ימים: Monday | שעה: 9:00-10:00 | מדריך/ה: "), brand, F.lit(" | אולם: "), kind, F.when(n % 2 == 0, F.lit(" | גברים | נשים | רמת בסיס | רמת המשך | aside")).otherwise(""))
    return [name, F.lit(rules.GROUPED_START[0]), name, detail, F.lit(f"{rules.GROUPED_END_PREFIX} end"), detail]


def layout_grouped(spark, sf):
    return _shown(extract.grouped(_paragraphs(spark, sf, *grouped_lines())), "day", "start_time", "end_time", "raw_name", "instructor", "location", "target_audience", "level", "notes")


def edge_lines() -> list[Column]:
    n, name, brand, kind = _columns()
    meta = F.concat(F.lit("מדריך/ה: "), brand, F.lit(" /  second | מיקום: "), kind, F.when(n % 3 == 0, F.lit(" – סניף ב'")).otherwise(""), F.lit(" | קהל: נשים"), F.when(n % 2 == 0, F.lit(" | חובה הרשמה מראש")).otherwise(""))
    return [name, F.lit(rules.EDGE_START[0]), F.lit("יום שלישי"), F.concat(F.lit("9:30 – 10:15 "), name), F.when(n % 5 != 0, meta), F.lit(rules.EDGE_END), F.lit("11:00-12:00 late")]


def layout_edge(spark, sf):
    return _shown(extract.edge(_paragraphs(spark, sf, *edge_lines())), "branch", "day", "start_time", "end_time", "raw_name", "instructor", "location", "target_audience", "notes")


#: Layouts by the part's number modulo 8; 6: named by the manifest but absent, 7: there but not named.
_LAYOUTS = ("basic", "dirty", "table", "bilingual", "grouped", "edge", "basic")


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A Word file for every part, in one of the six layouts, and the manifest that names them."""
    n, name, brand, kind = _columns()
    which = (F.col("p_partkey") % 8).cast("int")
    file = F.concat(F.format_string("%08d", "p_partkey"), F.lit(".docx"))
    grid = [[*map(F.lit, rules.TABLE_HEADER)], [F.lit(" 8.00 "), F.concat(name, F.lit("\n"), brand, F.lit("\n"), kind, F.when(n % 2 == 0, F.lit(f"\n{rules.MIXED}")).otherwise("")), F.lit("—")], [F.lit("no time"), brand, brand]]
    english = [[*map(F.lit, rules.BILINGUAL_COLUMNS)], [F.lit("Monday"), F.lit("6:05 PM - 7:00 PM"), F.concat(name, F.lit(" / יוגה")), brand, F.concat(kind, F.lit(" (Age "), n.cast("string"), F.lit("+)"))],
               [F.lit("—"), F.lit("9:00"), name, brand, kind]]
    table = lambda rows: F.array(F.array(*[F.array(*r) for r in rows]))
    lines = {0: basic_lines(), 1: dirty_lines(), 4: grouped_lines(), 5: edge_lines(), 7: [name]}
    paragraphs, tables = F.array(name), F.array().cast("array<array<array<string>>>")
    for k, own in lines.items():
        paragraphs = F.when(which == k, F.array_compact(F.array(*own))).otherwise(paragraphs)
    for k, own in ((2, grid), (3, english)):
        tables = F.when(which == k, table(own)).otherwise(tables)
    # A table in one file, but documents that many tasks can make and read.
    parts = _parts(spark, sf).repartition("p_partkey")
    files = documents.word_files(parts.where(which != 6).select(F.concat(F.lit("folder/"), file).alias("path"), paragraphs.alias("p"), tables.alias("t")), "path", "p", "t")
    layout = F.element_at(F.array(*[F.lit(x) for x in _LAYOUTS]), which + 1)
    return files, parts.where(which != 7).select(file.alias("source_file"), layout.alias("layout"))


def ingest_all(spark, sf):
    """Word files in all six layouts, by a manifest, as one table in the order of the files."""
    found, _ = extract.ingest_files(*_files(spark, sf), documents.contents)
    key = F.substring("source_file", 1, 8).cast("long").alias("p_partkey")
    return found.select(key, "ord", "center_name", "day", "start_time", "end_time", "raw_name", "instructor", "location", "target_audience", F.col("min_age").cast("long").alias("min_age"), "status")


def ingest_problems(spark, sf):
    """Files that the manifest names and that are absent, and files that it does not name."""
    return extract.routed(*_files(spark, sf))[1]


def workbook_rows(spark, sf):
    """Parts by brand as workbooks of two sheets, and the rows of one of them."""
    n, name, brand, kind = _columns()
    own = _parts(spark, sf).withColumn("file", F.concat(F.lit("books/"), (F.col("p_partkey") / 50).cast("int").cast("string"), F.lit(".xlsx")))
    row = F.array(F.col("p_partkey").cast("string"), name, F.when(n % 3 != 0, F.concat(F.lit(" "), kind)), F.when(n % 4 != 0, brand).otherwise("<&>"))
    # At most fifty parts in a book.
    books = own.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    head = F.array(*[F.lit(x) for x in (" Number", "Name", "Kind ", "Brand")])
    sheet = lambda title, rows: F.struct(F.lit(title).alias("name"), rows.alias("rows"))
    books = books.select("file", F.array(sheet("other", F.array(head)), sheet("parts & more", F.concat(F.array(head), F.col("rows")))).alias("sheets"))
    grid = documents.workbook_cells(documents.workbook_files(books, "file", "sheets"))
    found = documents.sheet_rows(grid, "parts & more", {"Number": "number", "Name": "name", "Kind": "kind", "Brand": "brand"})
    return found.select(F.col("number").cast("long").alias("p_partkey"), F.col("row_no").cast("long").alias("row_no"), "name", "kind", "brand")


def name_sides(spark, sf):
    n, name, _, kind = _columns()
    side = extract.split_name(_choice(n % 4, F.concat(F.lit("יוגה / "), name), F.concat(name, F.lit(" /יוגה")), F.concat(name, F.lit("/"), kind), name))
    return _parts(spark, sf).select("p_partkey", side["he"].alias("he"), side["en"].alias("en"))


def place_parts(spark, sf):
    n, _, brand, _ = _columns()
    size = n.cast("string")
    found = extract.place_details(F.concat(brand, _choice(n % 4, F.concat(F.lit(" (Age "), size, F.lit("+)")), F.concat(F.lit(" (age "), size, F.lit(" - "), (n + 9).cast("string"), F.lit(")")), " (upstairs) ", "")))
    return _parts(spark, sf).select("p_partkey", found["location"].alias("location"), found["min_age"].cast("long").alias("min_age"), found["max_age"].cast("long").alias("max_age"), found["note"].alias("note"))


def detail_fields(spark, sf):
    n, name, brand, _ = _columns()
    size = n.cast("string")
    text = F.concat_ws(
        " | ", F.concat(F.lit("מדריך/ה:  "), name), F.concat(F.lit("מיקום: "), brand, _choice(n % 3, " – סניף א'", " – סניף ב'", "")),
        _choice(n % 4, F.concat(F.lit("גילאי "), size, F.lit("-"), (n + 5).cast("string")), F.concat(F.lit("גיל "), size, F.lit("+"))),
        F.when(n % 2 == 0, F.concat(F.lit("עד "), size, F.lit(" משתתפים"))), F.when(n % 5 == 0, F.format_string("מתחיל ב-%d.%d.2025", n % 28 + 1, n % 12 + 1)), _choice(n % 6, "בחורף", "בקיץ"),
    )
    spot, (low, high) = extract.branch_of(extract.labelled(F.col("t"), rules.PLACE_KEY)), extract.ages_in(F.col("t"))
    return _parts(spark, sf).withColumn("t", text).select(
        "p_partkey", extract.labelled(F.col("t"), rules.INSTRUCTOR_KEY).alias("instructor"), spot["location"].alias("location"), spot["branch"].alias("branch"), low.cast("long").alias("min_age"),
        high.cast("long").alias("max_age"), extract.capacity_in(F.col("t")).cast("long").alias("capacity"), extract.valid_from_in(F.col("t")).alias("valid_from"), extract.season_in(F.col("t")).alias("season"),
    )


def audiences(spark, sf):
    n, name, _, _ = _columns()
    said, rest = extract.audience_from_notes(_choice(n % 3, F.concat(name, F.lit(f" | {rules.MIXED}")), rules.MIXED, name))
    named = rows.audience_by_name(F.when(n % 4 == 0, "יוגה").otherwise(name), "bilingual", n)
    unified = tx.unified_audience(_choice(n % 3, "Mixed", " Women only ", name))
    return _parts(spark, sf).select("p_partkey", said.alias("said"), rest.alias("rest"), named.alias("named"), unified.alias("unified"))


def field_forms(spark, sf):
    n, name, _, _ = _columns()
    day = td.canonical_day(_choice(n % 4, "Monday", " יום  שני ", "שני", name))
    status = td.status_of(_choice(n % 5, "", "שיעור בוטל", "Cancelled", "יעודכן", name))
    after, before = _choice(n % 6, "06:00", "09:00", "09:00", "09:00"), _choice(n % 6, "12:00", "09:00", "10:00", None, "09:00")
    return _parts(spark, sf).select("p_partkey", day.alias("day"), status.alias("status"), rows.daypart_of(after, before).alias("daypart"))


def turn_labels(spark, sf):
    text = F.when(F.col("turn") % 6 == 5, F.col("text")).otherwise(_choice(F.col("turn") % 6, " שלום!", "תודה רבה", "זה מספיק לי", "?!", "כן בבקשה."))
    c = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("t", text)
    return c.select("conv_id", "turn", conversation.label(F.col("t")).alias("label"), conversation.wants_more(F.col("t")).alias("more"), conversation.wants_no_more(F.col("t")).alias("no_more"))


def request_texts(spark, sf):
    n, name, _, kind = _columns()
    slots = {"category": name, "day": F.when(n % 2 == 0, kind), "start_after": F.when(n % 3 == 0, "09:00"), "start_before": F.when(n % 6 == 0, "09:00").when(n % 4 == 1, "17:00")}
    whole = conversation.completed(_choice(n % 3, " ", F.concat(F.lit("מה יש "), name), name))
    return _parts(spark, sf).select("p_partkey", conversation.request_text(slots).alias("request"), conversation.context_text(slots).alias("context"), whole.alias("completed"))


def eval_checks(spark, sf):
    n, name, brand, _ = _columns()
    loud = F.upper(brand)
    expected = F.struct(
        F.when(n % 7 == 0, "activity").alias("intent"), F.when(n % 2 == 0, 3).alias("exact_results"), F.when(n % 3 == 0, F.array(loud, F.lit("absent"))).otherwise(F.array(loud)).alias("must_contain"),
        F.when(n % 4 == 0, F.array(name)).alias("must_not_contain"), (n % 5 < 2).alias("allow_clarification"),
    )
    observed = F.struct(F.concat_ws(" ", name, brand).alias("final_answer"), (n % 5 == 0).alias("waiting_for_clarification"), F.when(n % 10 == 1, "activity").otherwise("other").alias("intent"))
    cases = _parts(spark, sf).select("p_partkey", expected.alias("expected"), observed.alias("observed"), (n % 6).cast("long").alias("result_count"), F.when(F.col("p_partkey") % 11 == 0, "boom").alias("error"))
    return evalcases.evaluate(cases).select("p_partkey", F.array_join("failures", ";").alias("failures"), "passed")


def _activities(spark: SparkSession, sf: str) -> DataFrame:
    n, name, brand, _ = _columns()
    none = F.lit(None).cast("string")
    return _parts(spark, sf).select(
        F.col("p_partkey").alias("ord"), F.when(n % 2 == 0, F.upper(name)).otherwise(name).alias("name"), brand.alias("center_name"), none.alias("branch"), F.lit("שני").alias("day"), F.lit("09:00").alias("start_time"),
        none.alias("end_time"), F.when(n % 2 == 0, name).alias("instructor"), F.when(n % 3 == 0, " ").otherwise(brand).alias("location"), F.when(n % 5 == 0, n).alias("min_age"),
        F.lit(None).cast("int").alias("max_age"), F.when(n % 4 == 0, "tbd").alias("status"), F.when(n % 6 == 0, rules.MIXED).alias("target_audience"),
    )


def activity_profile(spark, sf):
    return quality.activity_profile(_activities(spark, sf))


def same_activities(spark, sf):
    found = quality.same_activities(_activities(spark, sf).withColumn("instructor", F.lit("x")).withColumn("location", F.lit(None).cast("string")))
    return found.select(F.col("first").alias("first_part"), "n", F.get("members", F.lit(0)).alias("label"))


_BASE = "WITH p AS (SELECT *, p_size % 2 = 0 AS even FROM part)"

SQL = {
    "layout_basic": f"""{_BASE} SELECT p_partkey, p_name AS center_name, 'שני' AS day, format('{{:02d}}:{{:02d}}', p_size % 24, p_size % 60) AS start_time, '23:59' AS end_time, p_name AS name, p_brand AS instructor, p_type AS location,
        CASE WHEN even THEN 'גם לגברים' ELSE 'נשים' END AS target_audience, CASE WHEN even THEN 'extra' END AS notes FROM p""",
    "layout_dirty": """SELECT p_partkey, 'חמישי' AS day, ['09:15', '18:00', '20:00'][p_size % 3 + 1] AS start_time, CASE WHEN p_size % 3 = 1 THEN '19:00' END AS end_time, CASE WHEN p_size % 3 = 1 THEN 'explicit' ELSE 'missing' END AS end_time_source,
        p_name AS name, CASE WHEN p_size % 3 < 2 THEN p_brand END AS instructor, CASE WHEN p_size % 3 = 0 THEN p_type END AS location, ['active', 'cancelled', 'tbd'][p_size % 3 + 1] AS status FROM part""",
    "layout_grouped": f"""{_BASE} SELECT p_partkey, 'שני' AS day, '09:00' AS start_time, '10:00' AS end_time, p_name AS raw_name, p_brand AS instructor, p_type AS location, CASE WHEN even THEN 'נשים' END AS target_audience,
        CASE WHEN even THEN 'המשך' END AS level, CASE WHEN even THEN 'aside' END AS notes FROM p""",
    "layout_edge": f"""{_BASE} SELECT p_partkey, CASE WHEN m AND p_size % 3 = 0 THEN 'ב' END AS branch, 'שלישי' AS day, '09:30' AS start_time, '10:15' AS end_time, p_name AS raw_name, CASE WHEN m THEN p_brand || ' / second' END AS instructor,
        CASE WHEN m THEN p_type END AS location, CASE WHEN m THEN 'נשים' END AS target_audience, CASE WHEN m AND even THEN 'חובה הרשמה מראש | registration_required' END AS notes FROM (SELECT *, p_size % 5 <> 0 AS m FROM p)""",
    "ingest_all": """WITH p AS (SELECT *, p_partkey % 8 AS w, p_size % 2 = 0 AS even, p_size % 5 <> 0 AS m FROM part WHERE p_partkey % 8 < 6),
        f AS (SELECT *, CASE w WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 10001 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 3 END AS n FROM p),
        o AS (SELECT *, (sum(n + 1) OVER (ORDER BY p_partkey) - 1)::bigint AS ord FROM f)
        SELECT p_partkey, ord, p_name AS center_name, ['שני', 'חמישי', 'ראשון', 'שני', 'שני', 'שלישי'][w + 1] AS day,
            CASE w WHEN 0 THEN format('{:02d}:{:02d}', p_size % 24, p_size % 60) WHEN 1 THEN ['09:15', '18:00', '20:00'][p_size % 3 + 1] WHEN 2 THEN '08:00' WHEN 3 THEN '18:05' WHEN 4 THEN '09:00' ELSE '09:30' END AS start_time,
            CASE w WHEN 0 THEN '23:59' WHEN 1 THEN CASE WHEN p_size % 3 = 1 THEN '19:00' END WHEN 3 THEN '19:00' WHEN 4 THEN '10:00' WHEN 5 THEN '10:15' END AS end_time,
            CASE w WHEN 3 THEN p_name || ' / יוגה' ELSE p_name END AS raw_name,
            CASE WHEN w = 1 AND p_size % 3 = 2 THEN NULL WHEN w = 5 THEN CASE WHEN m THEN p_brand || ' / second' END ELSE p_brand END AS instructor,
            CASE WHEN w = 1 AND p_size % 3 <> 0 OR w = 5 AND NOT m THEN NULL ELSE p_type END AS location,
            CASE w WHEN 0 THEN CASE WHEN even THEN 'גם לגברים' ELSE 'נשים' END WHEN 1 THEN 'נשים' WHEN 2 THEN CASE WHEN even THEN 'גם לגברים' ELSE 'נשים' END
                WHEN 3 THEN 'גם לגברים' WHEN 4 THEN CASE WHEN even THEN 'נשים' END ELSE CASE WHEN m THEN 'נשים' END END AS target_audience,
            CASE WHEN w = 3 THEN p_size::bigint END AS min_age, CASE WHEN w = 1 THEN ['active', 'cancelled', 'tbd'][p_size % 3 + 1] ELSE 'active' END AS status FROM o""",
    "ingest_problems": "SELECT format('{:08d}.docx', p_partkey) AS source_file, CASE p_partkey % 8 WHEN 6 THEN 'absent' ELSE 'unrouted' END AS problem FROM part WHERE p_partkey % 8 > 5",
    "workbook_rows": """SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS row_no, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN p_type END AS kind, CASE WHEN p_size % 4 <> 0 THEN p_brand ELSE '<&>' END AS brand FROM part""",
    "name_sides": "SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN p_type WHEN 3 THEN p_name ELSE 'יוגה' END AS he, CASE WHEN p_size % 4 < 3 THEN p_name END AS en FROM part",
    "place_parts": """SELECT p_partkey, p_brand AS location, CASE WHEN p_size % 4 < 2 THEN p_size END::bigint AS min_age, CASE WHEN p_size % 4 = 1 THEN p_size + 9 END::bigint AS max_age,
        CASE WHEN p_size % 4 = 2 THEN 'upstairs' END AS note FROM part""",
    "detail_fields": """SELECT p_partkey, p_name AS instructor, p_brand AS location, ['א', 'ב', NULL][p_size % 3 + 1] AS branch, CASE WHEN p_size % 4 < 2 THEN p_size END::bigint AS min_age, CASE WHEN p_size % 4 = 0 THEN p_size + 5 END::bigint AS max_age,
        CASE WHEN p_size % 2 = 0 THEN p_size END::bigint AS capacity, CASE WHEN p_size % 5 = 0 THEN format('2025-{:02d}-{:02d}', p_size % 12 + 1, p_size % 28 + 1) END AS valid_from,
        CASE p_size % 6 WHEN 0 THEN 'winter' WHEN 1 THEN 'summer' END AS season FROM part""",
    "audiences": """SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'גם לגברים' ELSE 'נשים' END AS said, CASE WHEN p_size % 3 <> 1 THEN p_name END AS rest, CASE WHEN p_size % 4 = 0 OR p_size >= 16 THEN 'גם לגברים' ELSE 'נשים' END AS named,
        ['גם לגברים', 'נשים', p_name][p_size % 3 + 1] AS unified FROM part""",
    "field_forms": """SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN p_name ELSE 'שני' END AS day, ['active', 'cancelled', 'cancelled', 'tbd', 'active'][p_size % 5 + 1] AS status,
        ['morning', 'exact', 'between', 'after', 'before', NULL][p_size % 6 + 1] AS daypart FROM part""",
    "turn_labels": r"""SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'greeting' WHEN 1 THEN 'thanks' WHEN 2 THEN 'stop' WHEN 3 THEN 'symbols' WHEN 4 THEN 'message'
        ELSE CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') THEN 'message' ELSE 'symbols' END END AS label, turn % 6 = 4 AS more, turn % 6 IN (1, 2) AS no_more FROM conversations""",
    "request_texts": """WITH s AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_type END AS d, CASE WHEN p_size % 3 = 0 THEN '09:00' END AS a, CASE WHEN p_size % 6 = 0 THEN '09:00' WHEN p_size % 4 = 1 THEN '17:00' END AS b FROM part)
        SELECT p_partkey, 'אילו חוגים יש ' || concat_ws(' ', p_name, d, CASE WHEN a = b THEN 'בשעה ' || a ELSE nullif(concat_ws(' ', 'אחרי ' || a, 'לפני ' || b), '') END) || '?' AS request,
        concat_ws(chr(10), 'category: ' || p_name, 'day: ' || d, 'start_after: ' || a, 'start_before: ' || b) AS context, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'מה יש ' || p_name ELSE 'אילו חוגים יש ' || p_name || '?' END AS completed FROM s""",
    "eval_checks": """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'run failed: boom' ELSE concat_ws(';',
            CASE WHEN p_size % 7 = 0 AND p_size % 10 <> 1 THEN 'intent: expected=activity, actual=other' END, CASE WHEN p_size % 2 = 0 AND p_size % 6 <> 3 THEN 'result_count: expected=3, actual=' || (p_size % 6) END,
            CASE WHEN p_size % 3 = 0 THEN 'answer missing: absent' END, CASE WHEN p_size % 4 = 0 THEN 'answer should not have: ' || p_name END,
            CASE WHEN p_size % 5 = 1 AND p_size % 10 <> 1 THEN 'expected clarification or a known intent' END) END AS failures FROM part)
        SELECT p_partkey, failures, failures = '' AS passed FROM f""",
    "activity_profile": """SELECT 'center_name' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'day', 'שני', count(*) FROM part
        UNION ALL SELECT 'status', CASE WHEN p_size % 4 = 0 THEN 'tbd' ELSE 'missing' END, count(*) FROM part GROUP BY ALL UNION ALL SELECT 'target_audience', CASE WHEN p_size % 6 = 0 THEN 'גם לגברים' ELSE 'missing' END, count(*) FROM part GROUP BY ALL
        UNION ALL SELECT 'missing:instructor', 'missing', count(*) FROM part WHERE p_size % 2 <> 0 UNION ALL SELECT 'missing:location', 'missing', count(*) FROM part WHERE p_size % 3 = 0
        UNION ALL SELECT 'missing:end_time', 'missing', count(*) FROM part UNION ALL SELECT 'missing:age_range', 'missing', count(*) FROM part WHERE p_size % 5 <> 0""",
    "same_activities": """WITH g AS (SELECT min(p_partkey) AS first_part, count(*) AS n, arg_min(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END, p_partkey) AS name, p_brand FROM part GROUP BY lower(p_name), p_brand HAVING count(*) > 1)
        SELECT first_part, n, '#' || first_part || ' | ' || name || ' | ' || p_brand || ' | שני 09:00' AS label FROM g""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        ingest_all, ingest_problems, workbook_rows, layout_basic, layout_dirty, layout_grouped, layout_edge, name_sides, place_parts, detail_fields, audiences, field_forms, turn_labels, request_texts, eval_checks, activity_profile, same_activities,
    )
    return {f.__name__: f for f in found}
