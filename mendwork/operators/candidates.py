"""Candidate selectors for broken fields.

All candidates that the vocabulary can give are a constant table of a few
hundred rows, each with what it needs to be present in the page; a page's
candidates are those of its broken fields, filtered by the page's classes and
data attributes where the page is parsed.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import FIELDS, Selector, Strategy

# Words, element types and labels that name a field, in order
KEYWORDS = {
    "product_name": ("name", "title", "product-name", "product-title", "prod-title", "heading"),
    "price": ("price", "cost", "amount", "value", "current-price", "final-price", "sale-price", "our-price"),
    "currency": ("currency", "ccy", "curr"),
    "rating": ("rating", "stars", "score", "star-rating", "avg-rating"),
    "review_count": ("review-count", "reviews", "num-reviews", "reviews-count", "ratings"),
    "availability": ("availability", "stock", "stock-status", "in-stock", "out-of-stock"),
    "product_url": ("product-link", "product-url", "detail-link", "item-link"),
    "image_url": ("product-image", "product-img", "main-image", "primary-image"),
}
TAGS = {
    "product_name": ("h1", "h2", "h3", "h4"),
    "price": ("span", "div", "strong", "b"),
    "currency": ("span", "abbr", "small"),
    "rating": ("span", "div", "meter"),
    "review_count": ("span", "div"),
    "availability": ("div", "span"),
}
LABELS = {"price": ("Price", "Buy for", "Cost"), "currency": ("Currency",), "rating": ("Rated", "Rating"), "review_count": ("reviews", "ratings"), "availability": ("Availability", "Stock")}
TRANSFORMS = {"price": "price", "rating": "rating", "review_count": "int_from_text", "product_url": "url", "image_url": "url"}
ATTRS = {"product_url": "href", "image_url": "src"}
ROLES = {"product_name": [(t, None) for t in ("h1", "h2", "h3", "h4")], "product_url": [("a[href]", "href")], "image_url": [("img", "src")]}

def templates(field: str) -> list[dict]:
    """All candidates of a field in order; ``needs`` is a data attribute or a .class that the page must have."""
    words, tags = KEYWORDS.get(field, ()), TAGS.get(field, ("span", "div"))
    attr, transform = ATTRS.get(field), TRANSFORMS.get(field, "text")
    out: list[dict] = []

    def add(value: str, source: str, why: str, needs: str | None = None, kind: str = "css", own_attr: str | None = attr) -> None:
        if all((c["kind"], c["value"], c["attr"]) != (kind, value, own_attr) for c in out):
            out.append({"kind": kind, "value": value, "attr": own_attr, "transform": transform, "source": source, "rationale": why, "needs": needs})

    for w in words:
        add(f"[data-testid='{w}']", "attr", f"data-testid is {w}")
        add(f"[data-{w}]", "attr", f"data-{w} is in the page", f"data-{w}")
        add(f"[itemprop='{w}']", "attr", f"itemprop is {w}")
    for w in words:
        for value in (f".{w}", *(f"{t}.{w}" for t in tags)):
            add(value, "class-synonym", f"class {w} is in the page", f".{w}")
    for value, own in ROLES.get(field, ()):
        add(value, "tag-role", f"the usual element {value}", own_attr=own)
    for label in LABELS.get(field, ()):
        add(label, "text-anchor", f"next to the label {label}", kind="text-anchor", own_attr=None)
    for t in tags:
        for n in (1, 2):
            add(f"{t}:nth-of-type({n})", "positional", f"{t} number {n}", own_attr=None)
    return out


class CandidateProvider(Protocol):
    """Plug-in that proposes selectors; they pass the same tests and gate as all others."""

    name: str

    def propose(self, field: str, html: str, strategy: Strategy, broken_examples: list) -> list[Selector]: ...


def propose_with(provider: CandidateProvider, pages: DataFrame, keys: list[str], strategy: Strategy, html: str = "html", field: str = "field") -> DataFrame:
    """Candidates of a plug-in for every page and broken field, asked inside the tasks."""
    import pandas as pd

    def ask(batches):
        for pdf in batches:
            rows = []
            for at, page, f in zip(pdf.index, pdf["_html"], pdf["_field"]):
                for n, s in enumerate(provider.propose(f, page, strategy, []) or ()):
                    rows.append((*(pdf[k][at] for k in keys), f, n, s.kind, s.value, s.attr, s.transform, f"proposed by {provider.name}"))
            yield pd.DataFrame(rows, columns=[*keys, "field", "ord", "kind", "value", "attr", "transform", "rationale"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    given = pages.select(*keys, F.col(html).alias("_html"), F.col(field).alias("_field"))
    return given.mapInPandas(ask, f"{kinds}, field string, ord int, kind string, value string, attr string, transform string, rationale string")
