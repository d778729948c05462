"""Reading HTML as it comes: a tolerant walk over its tags and texts."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S,
)
#: The same where quotes do not close: a tag ends at the next angle bracket.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_START = re.compile(r"<(?=[a-zA-Z/!?])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block of text.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "legend", "main", "menu", "nav", "ol", "optgroup",
    "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag ends: elements of these names, but none beyond the borders.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Blocks that do not end an open paragraph.
_INSIDE_P = {"html", "body", "option", "optgroup", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "select"}
_P_BORDER = {"button", "td", "th", "caption", "table", "article", "section", "div", "main", "li", "blockquote", "body", "form", "aside", "nav", "footer", "header"}


def attributes(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``("open", name, attributes)``, ``("close", name, "")``, ``("text", "", text)`` with character
    references decoded, and ``("raw", name, content)`` for elements whose content is no markup."""
    at, n, last = 0, len(page), page.rfind(">")
    pattern = _TOKEN
    while at < n:
        m, begin = None, at
        while m is None and (start := _START.search(page, begin)):
            begin = start.start()
            if begin > last:
                # No tag ends here any more, but an open comment goes on to the end.
                begin = page.find("<!--", begin)
                m = pattern.match(page, begin) if begin >= 0 else None
                break
            m = pattern.match(page, begin)
            if m is None and pattern is _TOKEN:
                # A quote that nothing closes: from here on quotes are not followed.
                pattern = _PLAIN
                m = pattern.match(page, begin)
            begin += 1
        if m is None:
            yield "text", "", html.unescape(page[at:])
            return
        if m.start() > at:
            text = page[at : m.start()]
            yield "text", "", html.unescape(text) if "&" in text else text
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW and not m[3].endswith("/"):
            end = _RAW_END[name].search(page, at)
            stop = end.start() if end else n
            yield "raw", name, page[at:stop]
            at = stop


def ends_before(name: str, stack: list[str], open_: Counter[str]) -> int:
    """How many elements of the stack stay open when an element ``name`` begins.

    ``open_`` counts the elements of the stack by name, so that one which is not there is not searched for.
    """
    keep = len(stack)
    if open_["p"] and name in BLOCK and name not in _INSIDE_P:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] == "p":
                keep = k
                break
            if stack[k] in _P_BORDER:
                break
    names, border = _ENDS.get(name, (None, None))
    if names and any(open_[n] for n in names):
        for k in range(keep - 1, -1, -1):
            if stack[k] in border:
                break
            if stack[k] in names:
                keep = k
    return keep


def ends_at(name: str, stack: list[str], open_: Counter[str]) -> int:
    """How many elements stay open when an end tag comes; an inline one does not end blocks."""
    if not open_[name]:
        return len(stack)
    inline = name not in BLOCK
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] == name:
            return k
        if inline and stack[k] in BLOCK:
            break
        if name == "p" and stack[k] in _P_BORDER:
            break
    return len(stack)


def squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())
