"""Queries over name corrections, derived fields, other searches, ground truth and saved tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.operators import messages, rows, search
from taktwerk.plans.common import SLOTS, shared_folder, slots_of, table
from taktwerk.schemas import GROUND_TRUTH_COLUMNS
from taktwerk.sources import documents


def name_fixes(spark, sf):
    """Names by the table of corrections."""
    fixes = spark.createDataFrame(list(rules.NAME_FIXES.items()), "raw string, canonical string")
    raw = F.element_at(F.array(*[F.lit(x) for x in rules.NAME_FIXES], F.col("p_name")), (F.col("p_size") % 3 + 1).cast("int"))
    return rows.looked_up(table(spark, sf, "part").withColumn("raw", raw), "raw", fixes.withColumnRenamed("raw", "key"), "key", "canonical", "name").select("p_partkey", "name")


def derived_fields(spark, sf):
    """A row's category, whether a request asks for anything, and the values of a list each once in their order."""
    n = F.col("p_size")
    file = F.concat(F.col("p_brand"), F.when(n % 2 == 0, ".docx").otherwise(".xlsx"))
    wanted = {"day": F.when(n % 3 == 0, F.col("p_type")), "age": F.when(n % 5 == 0, n), "branch": F.lit(None).cast("string")}
    once = F.array_distinct(F.array((n % 3).cast("string"), (n % 2).cast("string"), F.lit("2"), F.lit("0")))
    category = search.category_of(F.when(n % 7 == 0, F.col("p_type")), file)
    return table(spark, sf, "part").select("p_partkey", category.alias("category"), search.any_filter(wanted).alias("asks"), F.array_join(once, ",").alias("once"))


def _places(spark, sf):
    n = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name"), F.col("p_type").alias("day"), F.format_string("%02d:%02d", n % 24, n % 60).alias("start_time"), F.col("p_brand").alias("location"),
        F.when(n % 4 != 0, F.col("p_name")).alias("target_age_group"), F.when(n % 3 != 0, n).alias("min_age"), F.lit("cancelled").alias("status"),
    )


def event_search(spark, sf):
    """Events for an age group on a day before an hour."""
    found = search.search_events(_places(spark, sf).withColumnRenamed("p_name", "name"), target_age_group="RED", day="economy", start_before="15:00")
    return found.select("ord", "name", "location", "target_audience")


def volunteer_search(spark, sf):
    """Posts for a volunteer of thirty, surest first; one without a least age is unknown."""
    found = search.search_volunteering(_places(spark, sf).withColumnRenamed("p_name", "title"), volunteer_age=30, location="brand#1")
    return found.select("ord", "name", "age_match")


def truth_sheet(spark, sf):
    """A ground-truth sheet with its thirteen headers, as workbooks of forty rows, read back under the names of the fields."""
    own = table(spark, sf, "part").withColumn("file", F.concat((F.col("p_partkey") / 40).cast("int").cast("string"), F.lit(".xlsx")))
    n = F.col("p_size")
    values = {"source_file": F.col("p_partkey").cast("string"), "name": F.col("p_name"), "day": F.when(n % 2 == 0, F.concat(F.lit("  "), F.col("p_type"), F.lit("\n"))), "instructor": F.when(n % 3 == 0, " ").otherwise(F.col("p_brand"))}
    row = F.array(*[values.get(new, F.lit(None).cast("string")) for new in GROUND_TRUTH_COLUMNS.values()])
    head = F.array(*[F.lit(h) for h in GROUND_TRUTH_COLUMNS])
    # At most forty parts in a book.
    books = own.groupBy("file").agg(F.collect_list(row).alias("rows"))
    books = books.select("file", F.array(F.struct(F.lit("לוח_שעות").alias("name"), F.concat(F.array(head), F.col("rows")).alias("rows"))).alias("sheets"))
    found = documents.ground_truth(documents.workbook_cells(documents.workbook_files(books, "file", "sheets")))
    return found.select(F.col("source_file").cast("long").alias("p_partkey"), "name", "day", "instructor", "trap")


def after_question(spark, sf):
    """An answer to a question asked back: slots that it does not give are those of the message before."""
    c = table(spark, sf, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    own = c.select(key, *slots_of(F.lower("text")))
    before = c.select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("id"), *slots_of(F.lower("text")))
    return messages.filled(before.join(own.select("id"), "id"), own, "id", SLOTS).select("id", *SLOTS)


def saved_tables(spark, sf):
    """A table saved in both forms, with dates as texts in records, and read under its schema; records that are none stand apart."""
    folder = shared_folder(spark, "saved")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderdate").cast("timestamp").alias("placed"))
    documents.save_table(o, f"{folder}/parquet")
    documents.save_table(documents.text_dates(o), f"{folder}/json", "json")
    lines = spark.read.text(f"{folder}/json").select(F.when(F.get_json_object("value", "$.o_orderkey").cast("long") % 100 == 0, F.concat(F.lit("broken "), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.text(f"{folder}/lines")
    records = documents.json_table(spark, f"{folder}/lines", "o_orderkey long, priority string, placed string", corrupt="bad")
    kept = spark.read.parquet(f"{folder}/parquet").groupBy(F.lit("parquet").alias("form"), "priority").agg(F.count(F.lit(1)).alias("n"), F.min(F.date_format("placed", "yyyy-MM-dd HH:mm:ss")).alias("first"))
    read = records.groupBy(F.when(F.col("bad").isNull(), "json").otherwise("broken").alias("form"), "priority").agg(F.count(F.lit(1)).alias("n"), F.min("placed").alias("first"))
    return kept.unionByName(read)


_SLOT_SQL = {"day": ("er", "d"), "category": ("ou", "c"), "start_after": ("st", "a"), "start_before": ("ei", "b")}

SQL = {
    "name_fixes": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'התעמלות מתונה' WHEN 1 THEN 'פילאטיס' ELSE p_name END AS name FROM part",
    "derived_fields": """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN p_type WHEN p_size % 2 = 0 THEN 'ספורט' END AS category, p_size % 3 = 0 OR p_size % 5 = 0 AS asks,
        ['0,2', '1,2,0', '2,0', '0,1,2', '1,0,2', '2,1,0'][p_size % 6 + 1] AS once FROM part""",
    "event_search": """SELECT p_partkey AS ord, p_name AS name, p_brand AS location, p_name AS target_audience FROM part
        WHERE p_size % 4 <> 0 AND contains(lower(p_name), 'red') AND contains(lower(p_type), 'economy') AND p_size % 24 * 60 + p_size % 60 <= 900""",
    "volunteer_search": "SELECT p_partkey AS ord, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE 'match' END AS age_match FROM part WHERE contains(lower(p_brand), 'brand#1') AND (p_size % 3 = 0 OR p_size <= 30)",
    "truth_sheet": "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS day, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS instructor, NULL::varchar AS trap FROM part",
    "after_question": "WITH s AS (SELECT conv_id * 1000 + turn AS id, "
    + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{c}' || turn END AS {s}" for s, (w, c) in _SLOT_SQL.items())
    + " FROM conversations) SELECT a.id, "
    + ", ".join(f"coalesce(a.{s}, b.{s}) AS {s}" for s in _SLOT_SQL)
    + " FROM s a JOIN s b ON b.id + 1 = a.id",
    "saved_tables": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed FROM orders)
        SELECT 'parquet' AS form, priority, count(*) AS n, min(placed) AS first FROM o GROUP BY ALL UNION ALL SELECT 'json', priority, count(*), min(placed) FROM o WHERE k % 100 <> 0 GROUP BY ALL
        UNION ALL SELECT 'broken', NULL, count(*), NULL FROM o WHERE k % 100 = 0 HAVING count(*) > 0""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (name_fixes, derived_fields, event_search, volunteer_search, truth_sheet, after_question, saved_tables)}
