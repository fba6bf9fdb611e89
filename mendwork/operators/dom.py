"""A tolerant HTML tree and a selector matcher on the standard library.

Elements have a tag, attributes, a parent, children and a place in document
order. The parser closes what HTML lets stay open (p, li, table parts) and
ignores stray end tags. Selectors: type, *, #id, .class, attribute tests,
:nth-of-type, :nth-child, :first-child, :last-child, the combinators
descendant, >, + and ~, and lists. A selector that cannot be read matches
nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from ..functions.html import feed

# HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CODE = frozenset(("script", "style", "template"))
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}


class Element:
    """``doc`` has all elements of the document in order; those of this one are from ``order`` + 1 to before ``end``."""

    __slots__ = ("tag", "attrs", "classes", "parent", "children", "order", "doc", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, order: int, doc: list[Element]) -> None:
        self.tag, self.attrs, self.parent, self.order, self.doc, self.end = tag, attrs, parent, order, doc, order + 1
        self.classes: list[str] = attrs["class"].split() if "class" in attrs else []
        self.children: list[Element | str] = []

    @property
    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self) -> Iterator[Element]:
        """Descendants in document order, without the element itself."""
        return iter(self.doc[self.order + 1 : self.end])

    def text(self) -> str:
        """Text pieces, each stripped, joined by one space."""
        out, todo = [], self.children[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                if piece := x.strip():
                    out.append(piece)
            elif x.tag not in CODE:
                todo += x.children[::-1]
        return " ".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.doc: list[Element] = []
        self.root = self.at = Element("", {}, None, -1, self.doc)

    def _shut(self, last: Element | None) -> None:
        """Every open element up to ``last`` ends here; with null the document too."""
        e, n = self.at, len(self.doc)
        while e is not None:
            e.end = n
            if e is last:
                self.at = e.parent
                return
            e = e.parent

    def _close(self, tags, stops=frozenset()) -> None:
        e = self.at
        while e.parent is not None and e.tag not in stops:
            if e.tag in tags:
                self._shut(e)
                return
            e = e.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close(_P, _P_STOPS)
        if tag in ENDS_SAME:
            self._close(*ENDS_SAME[tag])
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, len(self.doc), self.doc)
        self.doc.append(e)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self.at
        if at.tag == tag and at.parent is not None:
            at.end, self.at = len(self.doc), at.parent
        else:
            self._close((tag,))

    def handle_data(self, data):
        self.at.children.append(data)


_P, _P_STOPS = frozenset(("p",)), frozenset(("table", "button"))


def parse(html: str | None) -> Element:
    """The document as a nameless root element."""
    builder = _Builder()
    feed(builder, html)
    builder._shut(None)
    return builder.root


_NAME = r"[\w-]+"
_PART = re.compile(
    rf"""\s*(?P<comb>[>+~])\s*|(?P<gap>\s+)|(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[^\]\s]+))\s*)?\]
    |:(?P<pseudo>first-child|last-child|first-of-type|last-of-type|(?:nth-of-type|nth-child)\(\s*(?P<n>\d+)\s*\))""",
    re.VERBOSE,
)


_COMPILED: dict[str, tuple] = {}


def compiled(selector: str) -> tuple:
    """Alternatives of (combinator, tests) from right to left; () if it cannot be read."""
    if selector not in _COMPILED:
        if len(_COMPILED) > 4096:
            _COMPILED.clear()
        _COMPILED[selector] = _compile(selector)
    return _COMPILED[selector]


def _compile(selector: str) -> tuple:
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps, tests, comb, at = [], [], "", 0
        text = alternative.strip()
        while at < len(text):
            m = _PART.match(text, at)
            if not m or m.end() == at:
                return ()
            at = m.end()
            if m["comb"] or m["gap"]:
                if not tests:
                    return ()
                steps.append((comb, tuple(tests)))
                tests, comb = [], m["comb"] or " "
            elif m["tag"]:
                if m["tag"] != "*":
                    tests.append(("tag", m["tag"].lower(), None, None))
                else:
                    tests.append(("any", "", None, None))
            elif m["id"]:
                tests.append(("attr", "id", "=", m["id"]))
            elif m["cls"]:
                tests.append(("class", m["cls"], None, None))
            elif m["attr"]:
                value = next((v for v in (m["dq"], m["sq"], m["raw"]) if v is not None), None)
                tests.append(("attr", m["attr"].lower(), m["op"], value))
            else:
                tests.append(("pseudo", m["pseudo"].split("(")[0], None, int(m["n"] or 1)))
        if not tests:
            return ()
        steps.append((comb, tuple(tests)))
        out.append(tuple(reversed(steps)))
    return tuple(out)


def _passes(e: Element, tests: tuple) -> bool:
    for kind, name, op, value in tests:
        if kind == "tag":
            ok = e.tag == name
        elif kind == "class":
            ok = name in e.classes
        elif kind == "attr":
            own = e.attrs.get(name)
            ok = own is not None and (
                op is None
                or op == "=" and own == value
                or op == "~=" and value in own.split()
                or op == "^=" and bool(value) and own.startswith(value)
                or op == "$=" and bool(value) and own.endswith(value)
                or op == "*=" and bool(value) and value in own
                or op == "|=" and (own == value or own.startswith(value + "-"))
            )
        elif kind == "pseudo":
            peers = e.parent.elements
            if name.endswith("of-type"):
                peers = [p for p in peers if p.tag == e.tag]
            ok = (peers[-1] if name.startswith("last") else peers[value - 1] if value <= len(peers) else None) is e
        else:
            ok = True
        if not ok:
            return False
    return True


def _fits(e: Element, steps: tuple, at: int = 0) -> bool:
    comb, tests = steps[at]
    if not _passes(e, tests):
        return False
    if at + 1 == len(steps):
        return True
    if comb in (" ", ">"):
        up = e.parent
        while up is not None and up.parent is not None:
            if _fits(up, steps, at + 1):
                return True
            if comb == ">":
                return False
            up = up.parent
        return False
    peers = e.parent.elements
    before = peers[: peers.index(e)][::-1]
    return any(_fits(p, steps, at + 1) for p in (before[:1] if comb == "+" else before))


def select(root: Element, selector: str) -> Iterator[Element]:
    """Descendants of ``root`` that match, in document order."""
    alternatives = compiled(selector)
    tags = _tags(alternatives)
    if alternatives:
        for e in root.walk():
            if (tags is None or e.tag in tags) and any(_fits(e, steps) for steps in alternatives):
                yield e


def _tags(alternatives: tuple) -> set[str] | None:
    """The tags of what can match; null if one alternative takes any."""
    found = {next((name for kind, name, _, _ in steps[0][1] if kind == "tag"), None) for steps in alternatives}
    return None if None in found else found


class Values:
    """Raw values of a strategy's fields under a record root, from one walk for all css selectors."""

    def __init__(self, fields: dict) -> None:
        self.fields, self.any, self.by_tag = list(fields.values()), [], {}
        for n, s in enumerate(self.fields):
            if s.kind == "css" and (alternatives := compiled(s.value)):
                tags = _tags(alternatives)
                for listed in [self.any] if tags is None else [self.by_tag.setdefault(t, []) for t in tags]:
                    listed.append((n, alternatives))
        self.wanted = sum(1 for s in self.fields if s.kind == "css" and compiled(s.value))

    def of(self, root: Element) -> list[str | None]:
        """In the order of the fields."""
        found: list[Element | None] = [None] * len(self.fields)
        left, none = self.wanted, ()
        for e in root.walk() if left else ():
            for listed in (self.by_tag.get(e.tag, none), self.any):
                for n, alternatives in listed:
                    if found[n] is None and any(_fits(e, steps) for steps in alternatives):
                        found[n] = e
                        left -= 1
            if not left:
                break
        out = []
        for s, e in zip(self.fields, found):
            if s.kind != "css":
                out.append(first_value(root, s.kind, s.value, s.attr))
            else:
                out.append(None if e is None else e.attrs.get(s.attr) if s.attr else e.text())
        return out


def _xpath(root: Element, path: str, attr: str | None) -> str | None:
    """The ElementTree subset of XPath, with a final /text() or /@name, on the root's subtree."""
    m = re.match(r"^(.*?)(?:/(@[\w-]+|text\(\)))?$", path)
    steps, last = m[1], m[2]

    def copy(e: Element) -> ElementTree.Element:
        x = ElementTree.Element(e.tag or "document", e.attrs)
        for c in e.children:
            if isinstance(c, Element):
                x.append(copy(c))
            elif len(x):
                x[-1].tail = (x[-1].tail or "") + c
            else:
                x.text = (x.text or "") + c
        return x

    top = ElementTree.Element("top")
    top.append(copy(root))
    try:
        found = top.find("." + steps if steps.startswith("/") else steps)
    except (SyntaxError, KeyError, TypeError):
        return None
    if found is None:
        return None
    if last and last.startswith("@"):
        return found.get(last[1:])
    if last:
        return found.text
    return found.get(attr) if attr else "".join(found.itertext()).strip()


def first_value(root: Element, kind: str, value: str, attr: str | None) -> str | None:
    """Raw value of a selector under a record root; null if nothing matches."""
    if kind == "css":
        e = next(select(root, value), None)
        return None if e is None else e.attrs.get(attr) if attr else e.text()
    if kind == "attr-on-self":
        return root.attrs.get(attr or value)
    if kind == "text-anchor":
        label = value.lower()
        for e in root.walk():
            if label in e.text().lower():
                around = "".join(c if isinstance(c, str) else c.text() for c in e.parent.children)
                return around.replace(value, "").strip(" :·-")
        return None
    if kind == "xpath":
        return _xpath(root, value, attr)
    return value if kind == "static" else None


def fingerprint(root: Element, limit: int = 2000, top: int = 20) -> str:
    """The commonest tag and class combinations of the first elements, with their counts."""
    seen: Counter = Counter()
    for i, e in enumerate(root.walk()):
        if i == limit:
            break
        classes = ".".join(sorted(e.classes))
        seen[f"{e.tag}.{classes}" if classes else e.tag] += 1
    return ",".join(f"{k}={n}" for k, n in seen.most_common(top))
