"""Derivatives of web archives: metadata and plain-text conversion records for every response.

Archives are written with Spark's text writer: a record ends with two line breaks, which is the
writer's separator, so that each part is a valid WARC/1.0 file in one gzip stream.  They are read with
Spark's text reader, split at the version (1.0 or 1.1); a piece that is shorter than its Content-Length says
(because a version stands in a payload) is joined with the pieces after it.  A record whose length is wrong comes out
with that fault, and those behind it come out whole.

From each response come a metadata record (JSON: the source record's headers, the HTTP status and
headers, title, meta elements and links of the page) and a conversion record (its visible text).  Both
name the response in WARC-Refers-To and keep its target and date; ids follow from the response's
id, so that a second run gives the same ones.

Defined results: a page without a url or html becomes a response with an empty target or body, and
its conversion is empty; a payload that is no text is converted to an empty text; repeated rows each
give their records, with the same ids if they are the same; records of other types have no
derivatives; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm.common import shared_folder, sliced, with_text
from taktwerk.llm.markup import BLOCK, attributes, squeezed, tokens

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Fast compression: a tenth larger than the usual level, in less than half the time.
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Name space of record ids.
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:taktwerk:warc")
#: Elements and the attribute that links from them.
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "video": "src", "audio": "src", "form": "action", "embed": "src"}

DERIVED = "source_id string, record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_headers string, content string"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, chr(31).join(map(str, parts)))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the line breaks that end it."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return VERSION.encode() + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def _responses(date: str, id_header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            out = []
            if not begun and batch.num_rows:
                begun = True
                note = b"software: taktwerk\r\nformat: WARC File Format 1.0\r\n"
                head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", date)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                out.append(build(head, note).decode())
            for source, url, page in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html")), strict=True):
                body = (page or "").encode("utf-8", "surrogatepass")
                own = f"{id_header}: {source}\r\n" if source is not None else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body
                payload = digest(body)
                head = [
                    ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", source, url, payload)), ("WARC-Date", date), ("WARC-Target-URI", _one_line(url)),
                    ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)),
                ]
                out.append(build(head, block).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def write_responses(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, id_header: str = "X-Source-Row") -> None:
    """Write every page as a response record."""
    own = with_text(pages, {"id": id_col, "url": url_col, "html": html_col}).withColumn("id", F.col("id").cast("string"))
    own.mapInArrow(_responses(date, id_header), "value string").write.option("lineSep", END).options(**_GZIP).text(path)


def write_records(derived: DataFrame, path: str) -> None:
    """Write derived records as an archive of their own."""
    lines = F.concat_ws(
        "\r\n", F.lit(VERSION.rstrip()), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), F.concat(F.lit("WARC-Source-Payload-Digest: "), "source_payload_digest"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")), F.lit(""), F.col("content"),
    )
    derived.select(lines.alias("value")).write.option("lineSep", END).options(**_GZIP).text(path)


def header(headers: list[tuple[str, str]], name: str, default: str = "") -> str:
    """The first value of a header; names are told apart without regard to case."""
    return next((v for k, v in headers if k.lower() == name.lower()), default)


def listed(headers: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Headers by name for a JSON object: one that is repeated has the list of its values, in order."""
    out: dict[str, list[str]] = {}
    for k, v in headers:
        out.setdefault(k, []).append(v)
    return {k: v if len(v) > 1 else v[0] for k, v in out.items()}


def checked(stated: str, raw: bytes) -> str:
    """Whether a stated digest is the one of the bytes: ``pass``, ``fail``, or ``none`` if nothing (or another method) is stated."""
    return "none" if not stated.lower().startswith("sha1:") else "pass" if stated[5:].upper() == digest(raw)[5:] else "fail"


def _split(piece: bytes) -> tuple[list[tuple[str, str]], bytes, bool]:
    """Headers in order, block, and whether the block is as long as the headers say."""
    head, _, rest = piece.partition(b"\r\n\r\n")
    parts = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    headers = [(name.strip(), value.strip()) for name, colon, value in parts if colon]
    try:
        n = int(header(headers, "Content-Length", "0"))
    except ValueError:
        n = 0
    return headers, rest[:n], len(rest) >= n


#: What pieces of an archive are cut at; a record's piece goes on with the last digit of its version.
SPLIT = b"WARC/1."
#: A block that is said to be longer is given up where another record begins.
MOST_BLOCK = 1 << 28


def _opening(piece: bytes) -> tuple[list[tuple[str, str]], int, int | None] | None:
    """Headers, where the block begins, and its stated length, if a piece begins a record (of version 1.0 or 1.1)."""
    if piece[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers, _, _ = _split(piece[3 : end + 4])
    if not header(headers, "WARC-Type"):
        return None
    length = header(headers, "Content-Length")
    return headers, end + 4, int(length) if length.isascii() and length.isdigit() else None


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """Headers, block and fault of each record of one archive.

    A block that holds the cut itself is put together from its pieces by the stated length.  Where nothing but line ends stands
    behind that length, the length is right.  Else the record comes out with the fault ``length`` and what stands in its first piece, and
    reading goes on at the next piece that begins a record, so that a wrong length costs no record but its own.
    """
    waiting: deque[bytes] = deque()

    def take() -> bytes | None:
        return waiting.popleft() if waiting else next(pieces, None)

    while (piece := take()) is not None:
        found = _opening(piece)
        if found is None:
            continue
        headers, start, length = found
        if length is None:
            yield headers, piece[start:].removesuffix(END.encode()), "no length"
            continue
        parts, have = [piece], len(piece) - start
        while have < length + len(END):
            more = take()
            if more is None:
                break
            if length > MOST_BLOCK and _opening(more) is not None and parts[-1].endswith(END.encode()):
                waiting.appendleft(more)
                break
            parts.append(more)
            have += len(SPLIT) + len(more)
        block = SPLIT.join([parts[0][start:], *parts[1:]])
        if len(block) >= length and not block[length:].strip(b"\r\n"):
            yield headers, block[:length], None
        else:
            yield headers, parts[0][start:].removesuffix(END.encode()), "length"
            waiting.extendleft(reversed(parts[1:]))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            yield from zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        named = pa.array([list(dict(h).items()) for h, _, _ in rows], pa.map_(pa.string(), pa.string()))
        every = pa.array([[{"name": k, "value": v} for k, v in h] for h, _, _ in rows], pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))
        blocks, faults = pa.array([b for _, b, _ in rows], pa.binary()), pa.array([f for _, _, f in rows], pa.string())
        return pa.RecordBatch.from_arrays([named, every, blocks, faults], names=["headers", "all_headers", "block", "fault"])

    rows: list[tuple] = []
    size = 0
    for _, pieces in groupby(each(), key=lambda x: x[0]):
        for record in _records(piece for _, piece in pieces):
            rows.append(record)
            size += len(record[1])
            if len(rows) >= 1000 or size >= 8_000_000:
                yield made(rows)
                rows, size = [], 0
    if rows:
        yield made(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``headers`` (by name, of a repeated one the last), ``all_headers`` (every name and value, in order), ``block`` (bytes) and ``fault`` of every record of the archives.

    ``fault`` is null for a whole record, else ``length`` or ``no length``.  Files are read as gzip streams, each by one task.
    """
    pieces = spark.read.option("lineSep", SPLIT.decode()).text(path)
    schema = "headers map<string,string>, all_headers array<struct<name string, value string>>, block binary, fault string"
    return pieces.select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file")).mapInArrow(_whole, schema)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and decoded body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines[1:]) if colon]
    low = {k.lower(): v.lower() for k, v in headers}
    if low.get("transfer-encoding") == "chunked":
        joined, rest = b"", body
        while m := re.match(rb"([0-9a-fA-F]+)[^\r\n]*\r\n", rest):
            n = int(m[1], 16)
            joined, rest = joined + rest[m.end() : m.end() + n], rest[m.end() + n + 2 :]
            if not n:
                break
        body = joined
    try:
        if low.get("content-encoding") == "gzip":
            body = gzip.decompress(body)
        elif low.get("content-encoding") == "deflate":
            body = zlib.decompress(body)
    except (OSError, zlib.error, EOFError):
        body = b""
    return lines[0], headers, body


def page_facts(page: str) -> tuple[str, list[dict[str, str]], list[dict[str, str]], str]:
    """Title, meta elements, links and visible text of a page."""
    title, metas, links = "", [], []
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if parts and (text := squeezed(parts)):
            blocks.append(text)
        parts.clear()

    for kind, name, data in tokens(page):
        if kind == "text":
            parts.append(data)
        elif kind == "raw":
            if name == "title" and not title:
                title = squeezed([data])
        else:
            if name in BLOCK or name == "br":
                end()
            if kind == "open":
                if name == "meta":
                    metas.append(attributes(data))
                elif name in _LINKS and (url := attributes(data).get(_LINKS[name])):
                    links.append({"path": f"{name}@{_LINKS[name]}", "url": url})
    end()
    return title, metas, links, "\n".join(blocks)


def _charset(content_type: str) -> str:
    m = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I)
    try:
        "".encode(m[1]) if m else None
        return m[1] if m else "utf-8"
    except LookupError:
        return "utf-8"


def derivatives(headers: dict[str, str] | list[tuple[str, str]], block: bytes, id_header: str = "X-Source-Row") -> list[tuple]:
    """The metadata and the conversion of a response, as rows of ``DERIVED``."""
    headers = list(headers.items()) if isinstance(headers, dict) else headers
    status, http, body = http_parts(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    page = body.decode(_charset(kind), "replace") if "html" in kind or kind.startswith("text/") or not kind else ""
    title, metas, links, text = page_facts(page)
    source = next((v for k, v in http if k == id_header), None)
    refers, payload = header(headers, "WARC-Record-ID"), header(headers, "WARC-Payload-Digest")
    # A payload digest is one of the body as it was sent, before encodings are undone.
    sent = block.partition(b"\r\n\r\n")[2]
    facts = {
        "Envelope": {
            "WARC-Header-Metadata": listed(headers),
            "Digest-Check": {"Block": checked(header(headers, "WARC-Block-Digest"), block), "Payload": checked(payload, sent)},
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status, "Headers": listed(http), "Entity-Length": len(body), "Entity-Digest": digest(body),
                    "HTML-Metadata": {"Head": {"Title": title, "Metas": metas}, "Links": links},
                }
            },
        }
    }
    out = []
    for record_type, content_type, content in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", text)):
        raw = content.encode("utf-8", "replace")
        out.append((
            source, record_id(record_type, refers, payload), record_type, refers, header(headers, "WARC-Target-URI"), header(headers, "WARC-Date"), content_type,
            len(raw), digest(raw), payload, json.dumps(listed(headers), ensure_ascii=False, sort_keys=True), raw.decode(),
        ))
    return out


_TYPES = [pa.string()] * 7 + [pa.int64()] + [pa.string()] * 4
_NAMES = [x.split()[0] for x in DERIVED.split(", ")]


def _derived(id_header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for headers, block in zip(batch.column("all_headers").to_pylist(), batch.column("block").to_pylist(), strict=True):
                named = [(h["name"], h["value"]) for h in headers]
                if header(named, "WARC-Type") == "response":
                    rows += derivatives(named, block, id_header)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    return run


def derive(records: DataFrame, id_header: str = "X-Source-Row") -> DataFrame:
    """The derived records of the whole records of :func:`read_records`; what is left of a broken one is not derived from."""
    return records.where("fault IS NULL").select("all_headers", "block").mapInArrow(_derived(id_header), DERIVED)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back, and derive; ``page_id`` comes from the archive."""
    path = shared_folder(pages.sparkSession, "warc")
    write_responses(pages, path)
    out = derive(read_records(pages.sparkSession, path))
    return out.select(F.col("source_id").cast("long").alias("page_id"), *[c for c in out.columns if c != "source_id"])
