import base64
import gzip
import hashlib
import html
import json
import re
import time

import pyarrow as pa
import pytest

from taktwerk.llm import pages, warc


def text_of(page):
    return pages.main_text(pages.read_page(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just   text\n here", "just text here"),
        ("<p>a &amp; b&nbsp;&#233; &copy;</p><p> c</p>", "a & b é ©\nc"),
        ("<nav><ul><li>x</ul></nav><div class=ad>buy</div><article><h1>T</h1><p><b>one<br><p>two</article><footer>f", "T\none\ntwo"),
        ("<script>var t='</p>';</script><style>p{}</style><p>ok</p><!-- no --><noscript>no</noscript>", "ok"),
        ("<main><div class='cookie-notice'>we use</div><p>text <span class='share-buttons'>tweet</span> on</p></main><p>out</p>", "text on"),
        ("<header><p>site</p></header><div><p>text</p></div><aside>side</aside><form>mail <input></form>", "text"),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>x</p><section id='comments'><article class='comment'>hi</article></section></article>", "Head\nx"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\ntwo\na\nb\nc"),
        ("<div role='navigation'>m</div><div hidden>h</div><div style='display: none'>n</div><div class='page-with-sidebar'><p>t</div>", "t"),
        ("<p title='a>b'>x</p><p title=\"broken>y</p>", "x\ny"),
        ("a <b>bold</b><i>ital</i> 1 < 2", "a boldital 1 < 2"),
    ],
)
def test_main_text(page, want):
    assert text_of(page) == want


def test_site_templates_go_but_copied_articles_stay(spark):
    rows = []
    for i in range(12):
        body = "copied article" if i < 6 else f"own text number {i}"
        # Neither the teaser nor the note tells by its name what it is.
        page = f"<body><div class='x{'y'}'><div>Read our guide</div><p>Call us</p></div><div><p>{body}</p></div></body>"
        rows.append((i, "https://a.example/x", page))
        rows.append((100 + i, f"https://b{i}.example/x", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df, min_percent=50).collect()}
    for i in range(12):
        body = "copied article" if i < 6 else f"own text number {i}"
        assert got[i] == body
        assert got[100 + i] == f"Read our guide\nCall us\n{got[i]}"


def test_notes_inside_an_article(spark):
    page = "<article><p>{0}</p><div class='k7'>Sent from our office</div><p>Same line</p></article>"
    df = spark.createDataFrame([(i, "https://a.example/", page.format(f"text {i}")) for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {i: f"text {i}\nSame line" for i in range(8)}


def test_pages_against_their_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|b)>", article)]
        want = "\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


@pytest.fixture(scope="module")
def odd_pages(spark):
    text = "<p>" + "long text " * 30_000 + "</p>"
    rows = [(1, None, "<p>a</p>"), (2, "u", None), (3, "https://x.y/\r\nz", ""), (None, None, None), (4, "u", text), (4, "u", text), (5, "u", "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC/1.0\r\n\r\n\r\n")]
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "page_id long, url string, html string, row string, text string, subtree int")


def test_odd_pages(odd_pages):
    got = pages.extract(odd_pages).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:4] == [(0, 0), (1, 1), (2, 0), (3, 0)]
    assert pages.extract(odd_pages.limit(0)).count() == 0


def test_archive_round_trip(spark, odd_pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_responses(odd_pages, path)
    records = warc.read_records(spark, path).collect()
    got = [(r.headers, bytes(r.block)) for r in records if r.headers["WARC-Type"] == "response"]
    bodies = sorted(block.partition(b"\r\n\r\n")[2].decode() for _, block in got)
    assert bodies == sorted(r.html or "" for r in odd_pages.collect())
    for headers, block in got:
        assert int(headers["Content-Length"]) == len(block)
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    assert sum(r.headers["WARC-Type"] == "warcinfo" for r in records) >= 1


def test_derivatives_keep_what_they_come_from(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = warc.page_derivatives(df).collect()
    source = {r.page_id: r for r in df.collect()}
    assert sorted((r.page_id, r.record_type) for r in rows) == sorted((i, t) for i in source for t in ("conversion", "metadata"))
    for r in rows:
        page = source[r.page_id]
        assert r.target_uri == page.url and r.content_length == len(r.content.encode()) and r.block_digest == warc.digest(r.content.encode())
        assert r.source_payload_digest == warc.digest(page.html.encode())
        if r.record_type == "metadata":
            facts = json.loads(r.content)["Envelope"]
            assert facts["WARC-Header-Metadata"]["WARC-Record-ID"] == r.refers_to
            inner = facts["Payload-Metadata"]["HTTP-Response-Metadata"]
            assert inner["Entity-Digest"] == r.source_payload_digest
            assert [x["url"] for x in inner["HTML-Metadata"]["Links"]] == [html.unescape(x) for x in re.findall(r'<a href="([^"]*)"', page.html)]
        else:
            assert set("".join(text_of(page.html).split("\n"))) <= set(r.content)
            assert text_of(page.html) in r.content
    assert len({r.record_id for r in rows}) == len({(r.refers_to, r.record_type) for r in rows})
    derived = spark.createDataFrame(rows)
    warc.write_records(derived, str(tmp_path / "d"))
    back = {r.headers["WARC-Record-ID"]: bytes(r.block).decode() for r in warc.read_records(spark, str(tmp_path / "d")).collect()}
    assert back == {r.record_id: r.content for r in rows}
    assert warc.page_derivatives(df.limit(0)).count() == 0


def test_encoded_bodies():
    body = "<title>T</title><p>ü</p>".encode("latin-1")
    packed = gzip.compress(body)
    chunked = b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    meta, text = warc.derivatives({"WARC-Record-ID": "<a>", "WARC-Type": "response"}, block)
    assert text[-1] == "ü" and json.loads(meta[-1])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Head"]["Title"] == "T"
    assert warc.derivatives({}, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")[1][-1] == ""


def test_template_on_a_small_part_of_a_large_host(spark):
    """A section's box on 30 of 3000 pages, which no name, role or class tells."""
    box = "<div><div>In this section</div><div>Other stories of the section</div></div>"
    rows = [(i, f"https://hot.example/{i}", f"<html><body><div>{box if i < 30 else ''}<p>Story {i} begins with words.</p><p>It goes on, number {i}.</p></div></body></html>") for i in range(3000)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Story {i} begins with words.\nIt goes on, number {i}." for i in range(3000)}


def test_articles_in_sidebars_and_words_in_class_names():
    text = lambda page: pages.main_text(pages.read_page(page))
    teaser = '<div class="sidebar"><article><p>Teaser</p></article></div>'
    assert text(f"<body>{teaser}<article><h1>T</h1><p>Body text</p></article></body>") == "T\nBody text"
    assert text(f"<body>{teaser}<main><p>Body text</p></main></body>") == "Body text"
    assert text('<div class="content-sidebar-wrap"><article><p>only one</p></article></div>') == "only one"
    kept = "".join(f'<div class="{c}"><p>{c}</p></div>' for c in ("ad-free-note", "notice-board", "share-price", "social-history"))
    gone = "".join(f'<div class="{c}"><p>{c}</p></div>' for c in ("ad", "share-buttons", "ad-slot", "related-posts", "newsletter"))
    assert text(f"<article><h1>T</h1>{kept}{gone}</article>") == "T\nad-free-note\nnotice-board\nshare-price\nsocial-history"


def test_reading_takes_time_in_proportion():
    """Pages made to be slow: unclosed quotes and tags, deep nesting, end tags of nothing."""
    import time

    n = 100_000
    for page in ('<a "' * n, '<a "' * n + '>"', "<div>" * n + "x", "<div>" * n + "</section>" * n, "<!x" * n, "<" * n):
        began = time.perf_counter()
        read = pages.read_page(page)
        assert time.perf_counter() - began < 30
        assert "x" not in page[-1] or [b[1] for b in read.blocks][-1].endswith("x")


def test_repeated_headers_and_digests():
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n<p>x</p>"
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Concurrent-To", "<urn:uuid:2>"), ("WARC-Concurrent-To", "<urn:uuid:3>"), ("WARC-Payload-Digest", warc.digest(b"<p>x</p>")), ("WARC-Block-Digest", "sha1:AAAA")]
    headers, body, complete = warc._split(warc.build(head, block)[len(warc.VERSION) :])
    assert complete and body == block and headers[:-1] == head
    facts = json.loads(warc.derivatives(headers, block)[0][-1])["Envelope"]
    assert facts["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<urn:uuid:2>", "<urn:uuid:3>"]
    assert facts["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["Set-Cookie"] == ["a=1", "b=2"]
    assert facts["Digest-Check"] == {"Block": "fail", "Payload": "pass"}


def _pieces(archive: bytes):
    return iter(archive.split(warc.SPLIT))


def _record(name, block, length=None, version=b"WARC/1.0"):
    size = b"" if length == "none" else b"Content-Length: %d\r\n" % (len(block) if length is None else length)
    return version + b"\r\nWARC-Type: resource\r\nWARC-Record-ID: <" + name + b">\r\n" + size + b"\r\n" + block + b"\r\n\r\n"


def test_a_wrong_length_costs_its_own_record_only():
    quoted = b"before WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1. after"
    blocks = [b"one", quoted, b"", b"three\r\n\r\nWARC/1.0", b"last"]
    whole = [_record(b"r%d" % i, b, version=(b"WARC/1.0", b"WARC/1.1")[i % 2]) for i, b in enumerate(blocks)]
    read = lambda parts: [(warc.header(h, "WARC-Record-ID"), b, f) for h, b, f in warc._records(_pieces(b"".join(parts)))]
    want = [(f"<r{i}>", b, None) for i, b in enumerate(blocks)]
    assert read(whole) == want and read([]) == [] and read([b"junk", *whole]) == want
    for i, block in enumerate(blocks):
        for length in (10**6, len(block) + 900, "none") + ((len(block) - 2,) if len(block) > 2 else ()):
            got = read([*whole[:i], _record(b"r%d" % i, block, length), *whole[i + 1 :]])
            assert [x for x in got if x[0] != f"<r{i}>" and x[2] is None and x[0]] == [x for x in want if x[0] != f"<r{i}>"]
            assert [x[2] for x in got if x[0] == f"<r{i}>"] == ["no length" if length == "none" else "length"]
    # Cut off in the last record.
    assert read([*whole[:4], whole[4][:-6]])[-1] == ("<r4>", b"la", "length")


def test_a_length_beyond_all_measure_ends_at_the_next_record(monkeypatch):
    monkeypatch.setattr(warc, "MOST_BLOCK", 50)
    parts = [_record(b"a", b"x", 10**12), _record(b"b", b"y")]
    assert [(b, f) for _, b, f in warc._records(_pieces(b"".join(parts)))] == [(b"x", "length"), (b"y", None)]


def test_read_records_tells_of_faults(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(_record(b"a", b"x", 99) + _record(b"b", b"y", version=b"WARC/1.1") + _record(b"c", b"z"))
    got = warc.read_records(spark, f"file://{tmp_path}/a.warc")
    assert [(r.headers["WARC-Record-ID"], bytes(r.block), r.fault) for r in got.collect()] == [("<a>", b"x", "length"), ("<b>", b"y", None), ("<c>", b"z", None)]
    assert warc.derive(got).count() == 0


def test_menus_and_forms_go_at_any_depth():
    for depth in (5, 600, 40_000):
        page = "<div>" * depth + "<p>body</p><nav>MENU</nav><form>FORM</form>" + "</div>" * depth + "<p>after</p>"
        assert pages.main_text(pages.read_page(page)) == "body\nafter"


def test_templates_are_taken_out_in_proportion():
    """Every block against nested and neighbouring templates, by a plain test of all pairs; and a long list in little time."""
    page = pages.read_page("<div>" + "".join(f"<div>a{i}<div>b{i}</div></div>" for i in range(40)) + "</div>")
    for step in (2, 3, 7):
        some = {h for _, _, h in page.subtrees[::step]}
        gone = [(a, b) for a, b, h in page.subtrees if h in some]
        assert pages.main_blocks(page, some) == [x for x in page.blocks if not any(a <= x[0] < b for a, b in gone)]
    began = time.perf_counter()
    large = pages.read_page("".join(f"<div>x{i}</div>" for i in range(60_000)))
    assert len(pages.main_blocks(large, {h for _, _, h in large.subtrees[1:]})) == 1
    batch = pa.RecordBatch.from_pydict({"row": [1], "url": ["http://a/"], "html": ["".join(f"<div>x{i}</div>" for i in range(60_000))]})
    assert sum(b.num_rows for b in pages._subtrees(iter([batch]))) == 60_001
    assert time.perf_counter() - began < 60
