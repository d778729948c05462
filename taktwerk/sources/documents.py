"""Word documents and workbooks as tables of paragraphs and cells, JSON tables, and sinks.

The binary readers emit flat rows; a file is the unit that one task holds.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.functions.text import nullified
from taktwerk.schemas import CELL, GROUND_TRUTH_COLUMNS, PARAGRAPH

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _xml(raw: bytes, member: str) -> ElementTree.Element | None:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return ElementTree.fromstring(z.read(member)) if member in z.namelist() else None


def _elements(raw: bytes, member: str, *path: str) -> Iterator[ElementTree.Element]:
    """The elements at a path of tags below the root, one at a time as the member is read; each is emptied behind its use."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if member not in z.namelist():
            return
        depth, want = 0, len(path) + 1
        tags: list[str] = []
        with z.open(member) as stream:
            for event, node in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    depth += 1
                    tags.append(node.tag)
                    continue
                if depth == want and all(p in ("*", t) for p, t in zip(path, tags[1:], strict=True)):
                    yield node
                    node.clear()
                depth -= 1
                tags.pop()


def _text(node: ElementTree.Element) -> str:
    parts = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            parts.append(x.text or "")
        elif x.tag == f"{_W}tab":
            parts.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            parts.append("\n")
    return "".join(parts)


def docx_paragraphs(raw: bytes) -> list[str]:
    """The trimmed paragraphs of the body that are not blank, without those in tables."""
    found = (_text(p).strip() for p in _elements(raw, "word/document.xml", f"{_W}body", f"{_W}p"))
    return [t for t in found if t]


def docx_cells(raw: bytes) -> list[tuple[int, int, int, str]]:
    """Table, row, column and text of every cell; one that spans columns stands in each."""
    out = []
    for t, table in enumerate(_elements(raw, "word/document.xml", f"{_W}body", f"{_W}tbl")):
        above: dict[int, str] = {}
        for r, row in enumerate(table.findall(f"{_W}tr")):
            col = 0
            for cell in row.findall(f"{_W}tc"):
                text = "\n".join(_text(p) for p in cell.findall(f"{_W}p")).strip()
                span, merged = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
                if merged is not None and merged.get(f"{_W}val") != "restart":
                    text = above.get(col, "")
                for _ in range(int(span.get(f"{_W}val", "1")) if span is not None else 1):
                    above[col] = text
                    out.append((t, r, col, text))
                    col += 1
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(raw: bytes) -> list[tuple[str, int, int, str]]:
    """Sheet name, row, column and text of every cell that has a value."""
    book, links = (_xml(raw, m) for m in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"))
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _elements(raw, "xl/sharedStrings.xml", "*")]
    targets = {x.get("Id"): x.get("Target").lstrip("/") for x in links} if links is not None else {}
    out = []
    for sheet in book.iter(f"{_S}sheet") if book is not None else []:
        target = targets.get(sheet.get(f"{_R}id"), "")
        for row in _elements(raw, target if target.startswith("xl/") else f"xl/{target}", f"{_S}sheetData", f"{_S}row"):
            for cell in row.iter(f"{_S}c"):
                value, inline = cell.find(f"{_S}v"), cell.find(f"{_S}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else value.text if value is not None else None
                if text is not None:
                    text = shared[int(text)] if cell.get("t") == "s" else text
                    out.append((sheet.get("name"), int(row.get("r", "1")) - 1, _column(cell.get("r", "A")), text))
    return out


def _mapped(files: DataFrame, parse, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(_name(path), *row) for path, raw in zip(batch["path"], batch["content"], strict=True) for row in parse(bytes(raw))]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def document_files(spark: SparkSession, folder: str, pattern: str = "*.docx") -> DataFrame:
    """The files of a folder with their bytes; a folder that is missing is an error."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def paragraphs(files: DataFrame) -> DataFrame:
    """(source_file, n, text) of Word documents."""
    return _mapped(files, lambda raw: list(enumerate(docx_paragraphs(raw))), PARAGRAPH)


def cells(files: DataFrame) -> DataFrame:
    """(source_file, table_no, row_no, col_no, text) of Word documents."""
    return _mapped(files, docx_cells, CELL)


def contents(files: DataFrame) -> DataFrame:
    """Paragraphs and cells of Word documents in one table, each file opened once: those with ``n`` are paragraphs."""
    def both(raw: bytes) -> list[tuple]:
        lines = [(n, None, None, None, text) for n, text in enumerate(docx_paragraphs(raw))]
        return lines + [(None, *cell) for cell in docx_cells(raw)]

    return _mapped(files, both, "source_file string, n int, table_no int, row_no int, col_no int, text string")


def workbook_cells(files: DataFrame) -> DataFrame:
    """(source_file, sheet, row_no, col_no, text) of workbooks."""
    return _mapped(files, xlsx_cells, "source_file string, sheet string, row_no int, col_no int, text string")


def word_bytes(paragraphs: list[str], tables: list[list[list[str]]]) -> bytes:
    """A Word file with paragraphs, then tables (rows of texts; a line break in one begins a paragraph)."""
    line = lambda t: f"<w:p><w:r><w:t xml:space='preserve'>{escape(t)}</w:t></w:r></w:p>"
    cell = lambda t: "<w:tc>" + "".join(map(line, (t or "").split("\n"))) + "</w:tc>"
    grid = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"
    body = "".join(map(line, paragraphs)) + "".join(map(grid, tables))
    return _zipped({"word/document.xml": f"<w:document xmlns:w='{_W[1:-1]}'><w:body>{body}</w:body></w:document>"})


def workbook_bytes(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook with sheets of texts; a null leaves its cell out."""
    names, members, links = [], {}, []
    for k, (name, rows) in enumerate(sheets.items(), 1):
        lines = []
        for r, row in enumerate(rows, 1):
            cells = "".join(f"<c r='{_letters(c)}{r}' t='inlineStr'><is><t xml:space='preserve'>{escape(v)}</t></is></c>" for c, v in enumerate(row) if v is not None)
            lines.append(f"<row r='{r}'>{cells}</row>")
        members[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet xmlns='{_S[1:-1]}'><sheetData>{''.join(lines)}</sheetData></worksheet>"
        names.append(f"<sheet name={quoteattr(name)} sheetId='{k}' r:id='rId{k}'/>")
        links.append(f"<Relationship Id='rId{k}' Target='worksheets/sheet{k}.xml'/>")
    members["xl/workbook.xml"] = f"<workbook xmlns='{_S[1:-1]}' xmlns:r='{_R[1:-1]}'><sheets>{''.join(names)}</sheets></workbook>"
    members["xl/_rels/workbook.xml.rels"] = f"<Relationships>{''.join(links)}</Relationships>"
    return _zipped(members)


def _letters(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def word_files(df: DataFrame, path: str, paragraphs: str, tables: str) -> DataFrame:
    """``path, content`` of a Word file for each row: its paragraphs (texts) and tables (arrays of rows of texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lines, grids = (batch.column(i).to_pylist() for i in range(3))
            made = [word_bytes(p or [], t or []) for p, t in zip(lines, grids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return df.select(F.col(path).cast("string"), paragraphs, tables).mapInArrow(run, "path string, content binary")


def workbook_files(df: DataFrame, path: str, sheets: str) -> DataFrame:
    """``path, content`` of a workbook for each row: ``sheets`` is an array of name and rows of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [workbook_bytes({s["name"]: s["rows"] for s in row or []}) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return df.select(F.col(path).cast("string"), sheets).mapInArrow(run, "path string, content binary")


def sheet_rows(grid: DataFrame, sheet: str, columns: dict[str, str]) -> DataFrame:
    """A sheet's rows with the columns its first row names, renamed, trimmed, blank as null."""
    own = grid.where(F.col("sheet") == sheet)
    head = own.where("row_no = 0").select("source_file", "col_no", nullified(F.col("text")).alias("head"))
    body = own.where("row_no > 0").join(head, ["source_file", "col_no"])
    wide = body.groupBy("source_file", "row_no").pivot("head", list(columns)).agg(F.first("text")).drop("source_file")
    return wide.select("row_no", *[nullified(F.col(f"`{old}`")).alias(new) for old, new in columns.items()])


def ground_truth(grid: DataFrame, sheet: str = "לוח_שעות") -> DataFrame:
    """The ground-truth sheet of a workbook."""
    return sheet_rows(grid, sheet, GROUND_TRUTH_COLUMNS)


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A text column as numbered trimmed lines that are not blank: ``source_file, n, text``."""
    each = docs.select(F.col(key).cast("string").alias("source_file"), F.posexplode(F.split(text, "\n")).alias("n", "text"))
    return each.withColumn("text", F.trim("text")).where("text <> ''")


def json_table(spark: SparkSession, path: str, schema: str, required: bool = True, corrupt: str | None = None) -> DataFrame:
    """A file with an array of records under a declared schema (DDL); one that is no such array is an
    error, and so is a missing one unless it is not required: then the table is empty.

    With ``corrupt`` the file has one record per line, and one that does not fit is no error but
    stands in a column of that name.
    """
    if corrupt:
        schema = f"{schema}, {corrupt} string"
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load
    if not required:
        try:
            found(path).isEmpty()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return spark.createDataFrame([], schema)
            raise
    reader = spark.read.schema(schema)
    if not corrupt:
        whole = spark.read.option("wholetext", True).text(path)
        if not whole.where(~F.regexp_like("value", F.lit(r"^[\s\uFEFF]*\["))).isEmpty():
            raise ValueError(f"{path} holds no array of records")
    reader = reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader.option("multiLine", True).option("mode", "FAILFAST")
    return reader.json(path)


def save_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Overwrite a processed table; ``json`` writes one record per line, nulls included.  For one array see :mod:`taktwerk.sources.arrays`."""
    writer = df.write.mode("overwrite")
    writer.option("ignoreNullFields", False).json(path) if form == "json" else writer.parquet(path)


def text_dates(df: DataFrame) -> DataFrame:
    """Dates and timestamps as texts, for records that leave as JSON."""
    kinds = dict(df.dtypes)
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kinds[c].startswith(("timestamp", "date")) else F.col(c) for c in df.columns])
