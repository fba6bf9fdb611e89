"""Feeding pages to the standard library's event parser."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

_OPEN_TAG = re.compile(r"</?[A-Za-z]")
_GAP = "[ \\t\\n\\r\\f]"
_ATTR = rf'{_GAP}+([A-Za-z_][A-Za-z0-9_:.-]*)="([^"<]*)"'
#: a plain tag as it stands behind its <
_TAG = re.compile(rf"(/?)([A-Za-z][A-Za-z0-9]*)((?:{_ATTR.replace('(', '(?:')})*){_GAP}*(/?)>")
_PAIR = re.compile(_ATTR)
#: elements whose content is not plain markup in some version of the parser
_OTHER = frozenset("script style textarea xmp iframe noembed noframes noscript plaintext".split())
_READ: dict[str, tuple] = {}


def _read(part: str) -> tuple[int, tuple] | None:
    """(where the tag ends, (kind, name, attributes)) of what stands behind a <; null if it is no plain tag."""
    m = _TAG.match(part)
    if not m:
        end = part.find(">")
        return (end, ("!", part[1:end], None)) if end >= 0 and part[:8].lower() == "!doctype" else None
    slash, name, pairs, empty = m.groups()
    name = name.lower()
    if name in _OTHER or slash and (pairs or empty):
        return None
    return m.end() - 1, ("/" if slash else "." if empty else "", name, [(k.lower(), unescape(v) if "&" in v else v) for k, v in _PAIR.findall(pairs)])


def _tokens(html: str) -> list[tuple[tuple, str]] | None:
    """(tag, text behind it) of a page of plain tags alone, the first tag null; null if anything else is in it."""
    parts = html.split("<")
    out: list[tuple] = [(None, parts[0])]
    title = False
    for part in parts[1:]:
        end = part.find(">")
        tag = _READ.get(part[:end]) if end >= 0 else None
        if tag is None:
            read = _read(part)
            if read is None:
                return None
            if read[0] == end:
                if len(_READ) > 8192:
                    _READ.clear()
                _READ[part[:end]] = read[1]
            end, tag = read
        if title and tag[:2] != ("/", "title"):
            return None
        title = tag[1] == "title" and tag[0] != "/"
        out.append((tag, part[end + 1 :]))
    return None if title else out


def feed(parser: HTMLParser, html: str | None) -> None:
    """All of a page's events, in time that follows its length.

    A page of plain tags (no comments, scripts or stray signs; attributes in
    double quotes) is split here, which gives the same events several times
    faster; the parser reads all others. A tag that the page's end cuts off, as
    one with an open quote, is dropped with what it has swallowed, as browsers
    do; the parser would look for its end again from every sign behind it.
    """
    tokens = _tokens(html or "")
    if tokens is None:
        parser.feed(html)
        if _OPEN_TAG.match(parser.rawdata):
            parser.rawdata = ""
        parser.close()
        return
    start, end, data = parser.handle_starttag, parser.handle_endtag, parser.handle_data
    for tag, text in tokens:
        if tag is not None:
            kind, name, attrs = tag
            if kind == "":
                start(name, attrs)
            elif kind == "/":
                end(name)
            elif kind == ".":
                parser.handle_startendtag(name, attrs)
            else:
                parser.handle_decl(name)
        if text:
            data(unescape(text) if "&" in text else text)
