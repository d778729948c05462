"""Word files and workbooks written and read back, routing by a manifest, running totals over ranges."""

import random
import tracemalloc

from pyspark.sql import Window
from pyspark.sql import functions as F

from taktwerk.operators import extract, ranking
from taktwerk.sources import documents


def test_word_and_workbook_round_trip(spark):
    lines, grid = ["a & <b>", " שלום\tx ", ""], [["h", "k"], ["1\n2", "<&>"]]
    raw = documents.word_bytes(lines, [grid, [["other"]]])
    assert documents.docx_paragraphs(raw) == ["a & <b>", "שלום\tx"]
    assert documents.docx_cells(raw) == [(0, 0, 0, "h"), (0, 0, 1, "k"), (0, 1, 0, "1\n2"), (0, 1, 1, "<&>"), (1, 0, 0, "other")]
    book = documents.workbook_bytes({"one & 'two'": [["x", None, "é"], []], "b": [[None] * 27 + ["far"]]})
    assert documents.xlsx_cells(book) == [("one & 'two'", 0, 0, "x"), ("one & 'two'", 0, 2, "é"), ("b", 0, 27, "far")]
    df = spark.createDataFrame([("f/a.docx", lines, [grid]), ("f/b.docx", None, None)], "path string, p array<string>, t array<array<array<string>>>")
    files = documents.word_files(df, "path", "p", "t")
    assert [(r.source_file, r.n, r.text) for r in documents.paragraphs(files).orderBy("n").collect()] == [("a.docx", 0, "a & <b>"), ("a.docx", 1, "שלום\tx")]
    assert documents.cells(files).count() == 4


def test_a_long_sheet_is_read_row_by_row():
    book = documents.workbook_bytes({"s": [[f"v{i}"] * 5 for i in range(20_000)]})
    tracemalloc.start()
    n = sum(1 for _ in documents._elements(book, "xl/worksheets/sheet1.xml", f"{documents._S}sheetData", f"{documents._S}row"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and most < 12_000_000


def test_manifest_and_files_that_do_not_fit(spark):
    files = spark.createDataFrame([("a/x.docx",), ("a/y.docx",)], "path string").withColumn("content", F.lit(bytearray(documents.word_bytes(["t"], []))))
    manifest = spark.createDataFrame([("x.docx", "basic"), ("z.docx", "edge")], "source_file string, layout string")
    kept, problems = extract.routed(files, manifest)
    assert [(r.source_file, r.layout) for r in kept.collect()] == [("x.docx", "basic")]
    assert sorted(map(tuple, problems.collect())) == [("y.docx", "unrouted"), ("z.docx", "absent")]
    found, problems = extract.ingest_files(files, manifest, documents.contents)
    assert found.count() == 0 and problems.count() == 2 and "ord" in found.columns


def test_running_totals_over_ranges(spark):
    lot = random.Random(3)
    df = spark.createDataFrame([(i * 7919 % 1000, lot.randrange(9)) for i in range(1000)], "k long, v long").repartition(7)
    got = {r.k: r.t for r in ranking.running_total(df, ["k"], "v", "t").collect()}
    want = {r.k: r.t or 0 for r in df.select("k", F.sum("v").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)).alias("t")).collect()}
    assert got == want
    assert ranking.running_total(df.where("false"), ["k"], "v", "t").count() == 0
