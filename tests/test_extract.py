"""The six document layouts, from Word files built here to activity rows, and their ground truth."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from taktwerk.functions import rules
from taktwerk.operators import extract, rows
from taktwerk.sources import documents

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs, tables=()):
    """A Word file with paragraphs, then tables (lists of rows of texts; a newline is a paragraph)."""
    p = lambda t: "<w:p><w:r><w:t xml:space='preserve'>" + t.replace("&", "&amp;") + "</w:t></w:r></w:p>"
    cell = lambda t: "<w:tc>" + "".join(p(x) for x in t.split("\n")) + "</w:tc>"
    body = "".join(map(p, paragraphs)) + "".join("<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{W}'><w:body>{body}</w:body></w:document>")
    return out.getvalue()


FILES = {
    "01_basic.docx": (
        ["מרכז א", "מבוא", "08:00-08:50 לפני – הלוח", "לוח חוגים", "08:00-08:50 בלי – יום", "יום  ראשון", "שיעורי בוקר:", "08:00-08:50  יוגה – דנה – אולם (גם לגברים)",
         "9.15-10.00 פילאטיס – רון לוי – סטודיו – הביאו מזרן", "זו אינה פעילות", "יום שני", "10:00-11:00 זומבה"], []),
    rules.SOURCE_TABLE: (
        ["מרכז ב"], [[["אחר", "ראשון"]], [["שעה", "ראשון", "שני"], ["8.00", "יוגה\nמשה\nסטודיו\nגם לגברים", "—"], ["בלי שעה", "x", "y"], ["9.00", "אקווה אירובי\nרון", "ריקודי עם", "מעבר לכותרת"]]]),
    rules.SOURCE_DIRTY: (
        ["מרכז ג", "לוח חוגים", "יום ראשון", "8.00 - זומבה | יתעדכן | אולם", "7:00 בערב - יוגה, רון, סטודיו", "17:00-18:00 קיקבוקס | בוטל | גיל | מגרש | עוד", "17:00-18:00 קיקבוקס | בוטל | גיל | מגרש | עוד",
         "* הערה", "9:00 פילטיס – דנה", "יום שלישי", "8:30 ספינינג  רון  סטודיו"], []),
    "04_bilingual.docx": (
        ["Center D"], [[["Day", "Time", "Class / חוג", "Instructor", "Room"], ["Sunday", "6:05 PM - 7:00 PM", "Yoga / יוגה", "Dana", "Main Hall (Age 16+)"], ["Monday", "8:00 AM - 9:00 AM", "זומבה / Zumba", "Ron", "Pool (Age 6-9)"],
                        ["Tuesday", "10:00 AM", "HIIT", "—", "Gym (bring water)"], ["—", "10:00 AM", "No day", "x", "y"]]]),
    "05_grouped.docx": (
        ["מרכז ה", "החוגים שלנו", "ימים: יום ראשון | שעה: 8:00-9:00 | מדריך/ה: רון | אולם: סטודיו", "יוגה", "ימים: יום שני | שעה: 17:00-18:00 | מדריך/ה: רון | אולם: סטודיו | נשים | רמת מתחילים | הביאו מים",
         "ימים: יום שלישי | שעה: 17:00-18:00 | מדריך/ה: — | אולם: —", "ימים: שבור", "—", "ימים: יום שני | שעה: 17:00-18:00 | מדריך/ה: רון | אולם: סטודיו", "ט.ל.ח", "ימים: יום שני | שעה: 7:00-8:00 | מדריך/ה: רון | אולם: x"], []),
    "06_edge.docx": (
        ["מרכז ו", "לוח שיעורי סטודיו", "יום שלישי", "18:00-19:00 קפוארה גילאי 6-9", "מדריך/ה: אורה/ רון | מיקום: אולם – סניף א' | קהל: ילדים | עד 12 משתתפים | מתחיל ב-1.3.2026 | בליווי הורה בקיץ",
         "19:00-20:00 יוגה גיל 16+", "20:00-21:00 זומבה", "מדריך/ה: יתעדכן", "הודעות והערות חשובות", "21:00-22:00 לא פעילות"], []),
}
LAYOUTS = {"01_basic.docx": "basic", rules.SOURCE_TABLE: "table", rules.SOURCE_DIRTY: "dirty", "04_bilingual.docx": "bilingual", "05_grouped.docx": "grouped", "06_edge.docx": "edge"}
#: center, day, start, end, provenance, name, instructor, location, audience, min_age, max_age, status, notes
EXPECTED = [
    ("מרכז א", "ראשון", "08:00", "08:50", "explicit", "יוגה", "דנה", "אולם", "גם לגברים", None, None, "active", None),
    ("מרכז א", "ראשון", "09:15", "10:00", "explicit", "פילאטיס", "רון לוי", "סטודיו", "נשים", None, None, "active", "הביאו מזרן"),
    ("מרכז א", "שני", "10:00", "11:00", "explicit", "זומבה", None, None, "נשים", None, None, "active", None),
    ("מרכז ב", "ראשון", "08:00", "08:55", "inferred_source_rule", "יוגה", "משה", "סטודיו", "גם לגברים", None, None, "active", None),
    ("מרכז ב", "ראשון", "09:00", "09:45", "inferred_source_rule", "אקווה אירובי", "רון", None, "נשים", None, None, "active", None),
    ("מרכז ב", "שני", "09:00", "10:10", "inferred_source_rule", "ריקודי עם", None, None, "נשים", None, None, "active", None),
    ("מרכז ג", "ראשון", "08:00", None, "missing", "זומבה", None, "אולם", "נשים", None, None, "tbd", None),
    ("מרכז ג", "ראשון", "19:00", None, "missing", "יוגה", "רון", "סטודיו", "גם לגברים", None, None, "active", None),
    ("מרכז ג", "ראשון", "17:00", "18:00", "explicit", "קיקבוקס", "גיל", "מגרש", "גם לגברים", None, None, "cancelled", "עוד"),
    ("מרכז ג", "ראשון", "09:00", "09:50", "inferred_source_rule", "פילטיס", "דנה", None, "נשים", None, None, "active", None),
    ("מרכז ג", "שלישי", "08:30", "09:20", "inferred_source_rule", "ספינינג", "רון", "סטודיו", "גם לגברים", None, None, "active", None),
    ("Center D", "ראשון", "18:05", "19:00", "explicit", "יוגה", "Dana", "Main Hall", "גם לגברים", 16, None, "active", None),
    ("Center D", "שני", "08:00", "09:00", "explicit", "זומבה", "Ron", "Pool", "נשים", 6, 9, "active", None),
    ("Center D", "שלישי", "10:00", None, "explicit", "HIIT", None, "Gym", "נשים", None, None, "active", "bring water"),
    ("מרכז ה", "שני", "17:00", "18:00", None, "יוגה", "רון", "סטודיו", "נשים", None, None, "active", "הביאו מים"),
    ("מרכז ה", "שלישי", "17:00", "18:00", None, "יוגה", None, None, None, None, None, "active", None),
    ("מרכז ו", "שלישי", "18:00", "19:00", "explicit", "קפוארה גילאי 6-9", "אורה / רון", "אולם", "ילדים", 6, 9, "active", "עד 12 משתתפים | מתחיל ב-1.3.2026 | בליווי הורה בקיץ | requires_parent"),
    ("מרכז ו", "שלישי", "19:00", "20:00", "explicit", "יוגה גיל 16+", None, None, None, 16, None, "active", None),
    ("מרכז ו", "שלישי", "20:00", "21:00", "explicit", "זומבה", None, None, None, None, None, "active", None),
]
SHOWN = ["center_name", "day", "start_time", "end_time", "end_time_source", "name", "instructor", "location", "target_audience", "min_age", "max_age", "status", "notes"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    for name, content in FILES.items():
        (folder / name).write_bytes(docx(*content))
    (folder / "skipped.txt").write_text("no document")
    files = documents.document_files(spark, f"file://{folder}")
    layouts = spark.createDataFrame(list(LAYOUTS.items()), "source_file string, layout string")
    return extract.ingest(documents.paragraphs(files).cache(), documents.cells(files).cache(), layouts).cache()


def test_rows_of_all_layouts(table):
    got = sorted((tuple(r) for r in table.select(*SHOWN).collect()), key=repr)
    assert got == sorted(EXPECTED, key=repr)


def test_order_over_all_documents(table):
    got = table.select("source_file", "ord").orderBy("ord").collect()
    assert [r.source_file for r in got] == sorted(r.source_file for r in got)
    per_file = {}
    for r in got:
        per_file.setdefault(r.source_file, []).append(r.ord)
    assert all(max(a) < min(b) for a, b in zip(list(per_file.values()), list(per_file.values())[1:]))


def test_json_that_is_no_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    (tmp_path / "b.json").write_text(' [{"a": 1}, {"a": 2}]')
    with pytest.raises(ValueError):
        documents.json_table(spark, str(tmp_path / "a.json"), "a int")
    assert sorted(r.a for r in documents.json_table(spark, str(tmp_path / "b.json"), "a int").collect()) == [1, 2]


def test_details(table):
    by_name = {(r.center_name, r.name, r.start_time): r for r in table.collect()}
    edge = by_name["מרכז ו", "קפוארה גילאי 6-9", "18:00"]
    assert (edge.branch, edge.capacity, edge.valid_from, edge.season) == ("א", 12, "2026-03-01", "summer")
    grouped = by_name["מרכז ה", "יוגה", "17:00"]
    assert grouped.source_language == "he"
    assert {r.level for r in table.where(F.col("center_name") == "מרכז ה").collect()} == {"מתחילים", None}
    assert by_name["Center D", "זומבה", "08:00"].english_name == "Zumba"
    assert by_name["מרכז א", "פילאטיס", "09:15"].raw_time == "9.15-10.00"


def test_against_ground_truth(spark, table):
    """The same rows with planted traps: other dash, English audience, branch in the place, a wrong end."""
    truth = table.select("source_file", "day", "start_time", "end_time", "name", "instructor", "location", "branch", "target_audience", "ord")
    truth = truth.withColumn("location", F.when(F.col("branch").isNotNull(), F.concat("location", F.lit(" -  סניף א'"))).otherwise(F.col("location")))
    truth = truth.withColumn("target_audience", F.when(F.col("target_audience") == rules.MIXED, "Mixed").otherwise(F.col("target_audience")))
    truth = truth.withColumn("end_time", F.when(F.col("name") == "ריקודי עם", "10:00").otherwise(F.col("end_time"))).where("name <> 'HIIT'")
    pairs = rows.compared(truth.unionByName(truth), table, ["source_file", "day", "start_time", "name"], ["end_time", "instructor", "target_audience", "location", "branch"])
    score = rows.recall_precision(pairs).first()
    assert (score.matched, score.missing, score.extra, score.recall) == (len(EXPECTED) - 1, 0, 1, 1.0)
    found = rows.mismatch_counts(rows.mismatches(pairs, rows.activity_rules())).collect()
    assert sorted((r.source_file or "", r.field, r.n) for r in found) == [("", "end_time", 1), (rules.SOURCE_TABLE, "end_time", 1)]


def xlsx(sheet, rows_):
    """A workbook of one sheet with inline texts."""
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = "".join(f"<row r='{i + 1}'>" + "".join(f"<c r='{chr(65 + j)}{i + 1}' t='inlineStr'><is><t>{t}</t></is></c>" for j, t in enumerate(row) if t is not None) + "</row>" for i, row in enumerate(rows_))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook xmlns='{s}' xmlns:r='{r}'><sheets><sheet name='{sheet}' sheetId='1' r:id='rId1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet xmlns='{s}'><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    from taktwerk.schemas import GROUND_TRUTH_COLUMNS

    head = list(GROUND_TRUTH_COLUMNS)
    (tmp_path / "t.xlsx").write_bytes(xlsx("לוח_שעות", [head, ["f", "c", "ראשון", "08:00", None, " יוגה "], ["g", " "]]))
    grid = documents.workbook_cells(documents.document_files(spark, f"file://{tmp_path}", "*.xlsx"))
    got = documents.ground_truth(grid).orderBy("row_no").collect()
    assert [(r.source_file, r.center_name, r.day, r.end_time, r.name) for r in got] == [("f", "c", "ראשון", None, "יוגה"), ("g", None, None, None, None)]


def test_json_tables(spark, tmp_path):
    from taktwerk.schemas import EVENT

    (tmp_path / "e.json").write_text('[{"id": "1", "name": "x", "price": 3}, {"id": "2"}]')
    assert [tuple(r)[:2] for r in documents.json_table(spark, f"file://{tmp_path}/e.json", EVENT).orderBy("id").collect()] == [("1", "x"), ("2", None)]
    assert documents.json_table(spark, f"file://{tmp_path}/none.json", EVENT, required=False).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        documents.json_table(spark, f"file://{tmp_path}/none.json", EVENT).count()
    (tmp_path / "bad.json").write_text('[{"id": "1", "price": 3}, {"id": "2", "price": "x"}]')
    (tmp_path / "lines.json").write_text('{"id": "1", "price": 3}\n{"id": "2", "price": "x"}\n')
    kept = documents.json_table(spark, f"file://{tmp_path}/lines.json", EVENT, corrupt="bad").orderBy("id").collect()
    assert [r.bad is None for r in kept] == [True, False]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        documents.json_table(spark, f"file://{tmp_path}/bad.json", EVENT).collect()
    documents.save_table(spark.createDataFrame([("ש", None)], "a string, b int"), f"file://{tmp_path}/out", "json")
    assert any('{"a":"ש","b":null}' in p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_rows_of_a_table_are_dealt_before_they_are_put_together(spark, monkeypatch):
    cells = [("f", 0, 0, 0, "A"), ("f", 0, 0, 1, "B "), ("f", 0, 0, 2, "A"), *[("f", 0, r, c, f"{r}{c}") for r in range(1, 6) for c in (2, 1, 0)], ("f", 0, 6, 1, "61")]
    grid = spark.createDataFrame(cells, "source_file string, table_no int, row_no int, col_no int, text string")
    for most in (10_000, 0):
        monkeypatch.setattr(extract, "SENT_HEADERS", most)
        out = extract.named_rows(grid, {"A": "a", "B": "b"})
        assert sorted(tuple(r) for r in out.select("row_no", "a", "b").collect()) == [*[(r, f"{r}0", f"{r}1") for r in range(1, 6)], (6, None, "61")]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.rindex("SortAggregate") < plan.index("REPARTITION_BY_COL")


def test_documents_are_routed_without_sending_the_manifest(spark, sf_dir):
    from taktwerk.plans import layouts

    files, manifest = layouts._files(spark, sf_dir)
    kept, problems = extract.routed(files.select("path"), manifest)
    for df in (kept, problems):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_dirty_lines_are_read_once(spark, sf_dir):
    """No filter holds the line's times or parts a second time, rules of a known size are sent, and documents are dealt before they become lines."""
    from taktwerk.plans import layouts

    df = layouts.layout_dirty(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "- Filter " in line]
    assert filters and not [line for line in filters if "regexp_extract" in line or "split(" in line]
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
    lines = plan.index("Generate posexplode")
    assert "Exchange" not in plan[:lines] and "REPARTITION_BY_COL" in plan[lines:]


def test_texts_without_a_time_raise_no_errors(spark):
    """An empty text is null before it is cast: a million texts of which no half is a number would else be a million errors."""
    from taktwerk.functions import timeofday

    df = spark.createDataFrame([("18:00",), ("6:05 pm",), ("24:00",), ("no time",), ("",), (None,), ("7:30 " + rules.EVENING,)], "t string")
    out = df.select(timeofday.canonical_time(F.col("t")).alias("c"), timeofday.seconds_of(F.col("t")).alias("s"), timeofday.status_of(F.col("t")).alias("x"))
    assert [(r.c, r.s) for r in out.collect()] == [("18:00", 64800), ("18:05", 21900), (None, None), (None, None), (None, None), (None, None), ("19:30", 27000)]
    assert {r.x for r in out.collect()} == {"active"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast(") == len(re.findall(r"= \)\) (?:null|false) else (?:isnotnull)?\(*try_cast\(", plan)) > 0
