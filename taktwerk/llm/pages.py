"""The main text of web pages, with the templates of their sites taken out.

Every element subtree that can hold a part of a template (a block outside the article, or a
container other than a paragraph inside it) is hashed with its tags, classes and texts.  Spark counts for each host
on how many pages with different main texts a subtree stands; those on many are templates, and the
blocks in them are deleted.  Besides, elements that are no part of an article by their name,
role or class go: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comments; inside an article a class tells that only as a whole.  If the page marks an article or its
main part, what lies outside goes too; an article inside a dropped part (a teaser in a sidebar) counts only where
none stands outside.  Elements nested deeper than ``MOST_DEPTH`` are read as parts of the one at that depth.

Defined results: a null or empty page, or one without any text, gives an empty text; a null url
is a host of its own; pages that are copies of one page count once, so copying an article does
not make it a template; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm.common import materialize, sliced, with_text
from taktwerk.llm.markup import BLOCK, HEADINGS, RAW, VOID, attributes, ends_at, ends_before, squeezed, tokens

#: A subtree is a template if it stands on so many pages of the host, and on this part of them.
MIN_PAGES = 3
MIN_PERCENT = 5
#: The part stops growing at so many pages, however large the host is.
MANY_PAGES = 20

#: Elements and roles that are never part of an article's text.
_DROP_NAMES = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "fieldset", "footer", "form", "head", "iframe", "input", "map", "math", "menu", "nav",
    "noscript", "object", "search", "select", "svg", "template", "video",
} | RAW
_DROP_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: Parts of class names and ids that tell the same.
_DROP_WORDS = {
    "ad", "adbox", "ads", "adsense", "adslot", "adunit", "adv", "advert", "advertisement", "advertising", "adverts", "aside", "banner", "breadcrumb", "breadcrumbs",
    "consent", "cookie", "cookies", "copyright", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notification", "outbrain", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "submenu", "subscribe", "subscription", "taboola", "toolbar", "topbar", "widget",
}
#: The same for what even an article in it does not bring back.
_DROP_FIRM = {"comment", "comments", "commentlist", "disqus", "recommended", "recommendations", "related", "replies", "respond", "responses", "trending"}
#: Words that say nothing by themselves beside one of the words above.
_FILLERS = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "inline", "inner", "items", "link", "links", "list", "panel", "posts", "section", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_KEEP, _SOFT, _FIRM, _HEAD = 0, 1, 2, 3  # kept; dropped, but for an article inside; dropped; only headings kept


@dataclass
class Page:
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # place, text, zone (3 article, 2 main, 1 one of these in a dropped part, 0 other)
    subtrees: list[tuple[int, int, int]] = field(default_factory=list)  # first place, last place, hash


def _verdict(name: str, raw: str, zone: int, above: int) -> int:
    if above == _FIRM or name in _DROP_NAMES:
        return _FIRM
    if name in ("article", "main"):
        found = attributes(raw) if raw else {}
        own = _FIRM if set(_WORD.findall(found.get("class", ""))) & _DROP_FIRM else _KEEP
        return max(own, _KEEP) if above in (_KEEP, _SOFT) else above
    if name == "header":
        return _HEAD if zone else max(above, _SOFT)
    if above == _HEAD:
        return _KEEP if name in HEADINGS else _HEAD
    if not raw or above:
        return above
    low = raw.lower()
    if not any(k in low for k in ("class", "id", "role", "hidden", "style")):
        return above
    found = attributes(raw)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return _FIRM
    if found.get("role", "").lower() in _DROP_ROLES:
        return _SOFT
    if name in ("html", "body"):
        return above
    words: set[str] = set()
    for label in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = {w.lower() for w in _WORD.findall(label)}
        if zone and not parts <= _DROP_WORDS | _DROP_FIRM | _FILLERS | {"header"}:
            continue
        if not {"has", "with", "no", "without"} & parts:
            words.update(parts)
    if words & _DROP_FIRM:
        return _FIRM
    if words & _DROP_WORDS:
        return _SOFT
    if "header" in words:
        return _HEAD if zone else _SOFT
    return above


def read_page(page: str | None) -> Page:
    """The blocks of text that may be main text, in order, and the hashed subtrees."""
    out = Page()
    names: list[str] = []
    # Of each open element: verdict, zone, and where its hashed content and its places begin (-1: not hashed).
    marks: list[tuple[int, int, int, int]] = []
    content: list[str] = []
    kept: list[str] = []
    lost: list[str] = []
    open_: Counter[str] = Counter()
    place = 0

    def end_block() -> None:
        nonlocal kept, lost, place
        if not kept and not lost:
            return
        text, other = squeezed(kept), squeezed(lost)
        kept, lost = [], []
        if text:
            out.blocks.append((place, text, marks[-1][1] if marks else 0))
        if text or other:
            content.append(f"{text} {other}")
            place += 1

    def close_to(keep: int) -> None:
        while len(names) > keep:
            if names[-1] in BLOCK:
                end_block()
            open_[names.pop()] -= 1
            _, _, begin, first = marks.pop()
            if begin >= 0 and place > first:
                own = xxhash.xxh64_intdigest("\x1f".join(content[begin:]).encode("utf-8", "surrogatepass")) >> 1
                out.subtrees.append((first, place, own))
                # For the elements around, the hash stands for all that is in it.
                content[begin:] = [f"#{own:x}"]

    for kind, name, data in tokens(page or ""):
        if kind == "text":
            (lost if marks and marks[-1][0] != _KEEP else kept).append(data)
        elif kind == "open":
            if name == "br":
                end_block()
                continue
            if name in VOID:
                if name == "hr":
                    end_block()
                continue
            if name in BLOCK:
                end_block()
            close_to(ends_before(name, names, open_))
            above, zone = (marks[-1][0], marks[-1][1]) if marks else (_KEEP, 0)
            verdict = _verdict(name, data, zone, above)
            if verdict == _KEEP and (name == "article" or name == "main" or "main" in data or "articleBody" in data):
                found = attributes(data)
                own = 3 if name == "article" or found.get("itemprop") == "articleBody" else 2 if name == "main" or found.get("role") == "main" else 0
                zone = max(zone, 1 if own and (above == _SOFT or zone == 1) else own)
            hashed = name in BLOCK and name not in ("html", "body", "article", "main", "li") and not (zone in (1, 3) and name in HEADINGS | {"p", "blockquote", "pre"})
            label = ""
            if hashed:
                label = f"<{name} {attributes(data).get('class', '')}" if data else f"<{name}"
            begin = len(content) if hashed else -1
            if name in BLOCK:
                content.append(label or f"<{name}")
            names.append(name)
            open_[name] += 1
            marks.append((verdict, zone, begin, place))
        elif kind == "close":
            keep = ends_at(name, names, open_)
            if keep < len(names):
                close_to(keep)
    close_to(0)
    end_block()
    return out


def main_blocks(page: Page, templates: set[int] | frozenset[int] = frozenset()) -> list[tuple[int, str, int]]:
    """The blocks of the article, or else of the main part, or else of the page, that lie in no template."""
    gone = sorted((a, b) for a, b, h in page.subtrees if h in templates)
    begins, ends = [a for a, _ in gone], list(accumulate((b for _, b in gone), max))
    # Of the templates that begin up to a place, the one that ends last decides.
    left = [x for x in page.blocks if not (k := bisect_right(begins, x[0])) or ends[k - 1] <= x[0]]
    best = max((zone for _, _, zone in left), default=0)
    return [x for x in left if x[2] == best]


def main_text(page: Page, templates: set[int] | frozenset[int] = frozenset()) -> str:
    return "\n".join(text for _, text, _ in main_blocks(page, templates))


def _host(url: str | None) -> str:
    if url is None:
        return "-"
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return "=" + (m[1].lower() if m else "")


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = []
        for row, url, page in zip(*(batch.column(c) for c in ("row", "url", "html")), strict=True):
            read = read_page(page.as_py())
            kept = main_blocks(read)
            main = xxhash.xxh64_intdigest("\n".join(x[1] for x in kept).encode("utf-8", "surrogatepass")) >> 1
            seen: dict[int, bool] = {}
            places = [x[0] for x in kept]
            for a, b, h in read.subtrees:
                seen[h] = seen.get(h, False) or bisect_left(places, a) < bisect_left(places, b)
            rows += [(row.as_py(), _host(url.as_py()), h, main, matters) for h, matters in seen.items()]
            rows.append((row.as_py(), _host(url.as_py()), None, main, False))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "host", "subtree", "main", "matters"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = [main_text(read_page(page.as_py()), frozenset(t.as_py() or ())) for page, t in zip(batch.column("html"), batch.column("templates"), strict=True)]
        n = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), n], names=["id", "url", "text", "n_chars"])


def site_templates(subtrees: DataFrame, min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT) -> DataFrame:
    """``host, subtree`` of the subtrees on many pages; pages with the same main text are one."""
    pages = subtrees.where(F.col("subtree").isNull()).select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    on = subtrees.where(F.col("subtree").isNotNull()).select("host", "subtree", "main").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    pages = materialize(pages, "host-pages")
    return on.where(F.col("n") >= min_pages).join(pages, "host").where((F.col("n") * 100 >= F.col("pages") * min_percent) | (F.col("n") >= MANY_PAGES)).select("host", "subtree")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT) -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``."""
    own = with_text(pages, {"id": id_col, "url": url_col, "html": html_col})
    own = own.select(F.col("id").cast("long").alias("id"), F.xxhash64("url", "html").alias("row"), "url", "html")
    subtrees = materialize(own.select("row", "url", "html").mapInArrow(_subtrees, "row long, host string, subtree long, main long, matters boolean"), "subtrees")
    templates = materialize(site_templates(subtrees, min_pages, min_percent), "templates")
    # Only templates with text that would be kept otherwise have to reach their pages.
    hits = subtrees.where("matters").select("row", "host", "subtree").join(templates, ["host", "subtree"])
    hits = materialize(hits.groupBy("row").agg(F.collect_set("subtree").alias("templates")), "page-templates")
    joined = own.join(hits, "row", "left").select("id", "url", "html", "templates")
    out = joined.mapInArrow(_texts, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
