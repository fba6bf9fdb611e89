"""Records, strategies, vocabularies and thresholds."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: the nominal fields of a record, in order
FIELDS = ("product_name", "price", "currency", "rating", "review_count", "availability", "product_url", "image_url")
KINDS = {"price": "double", "rating": "double", "review_count": "bigint"}  # the others are strings
ID = "product_id"

#: A record's columns beside the key columns. A value of the wrong type is null
#: in its own column and kept as text in ``loose`` under the field's name.
RECORD = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField(ID, T.StringType()),
    *[T.StructField(f, {"double": T.DoubleType(), "bigint": T.LongType()}.get(KINDS.get(f, ""), T.StringType())) for f in FIELDS],
    T.StructField("loose", T.MapType(T.StringType(), T.StringType())),
])


@dataclass(frozen=True)
class Selector:
    """How to find one raw value: kind css, xpath, attr-on-self, text-anchor or static."""

    kind: str
    value: str
    attr: str | None = None
    transform: str = "text"

    def to_dict(self) -> dict:
        return {"kind": self.kind, "value": self.value, "attr": self.attr, "transform": self.transform}

    @classmethod
    def from_dict(cls, d: dict) -> Selector:
        return cls(d["kind"], d["value"], d.get("attr"), d.get("transform", "text"))


@dataclass(frozen=True)
class Strategy:
    """A record selector and an ordered selector for each field."""

    name: str
    record_selector: str
    fields: dict[str, Selector] = field(default_factory=dict)
    next_page_selector: str | None = None
    notes: str = ""

    def to_dict(self) -> dict:
        return {"name": self.name, "record_selector": self.record_selector, "fields": {k: s.to_dict() for k, s in self.fields.items()}, "next_page_selector": self.next_page_selector, "notes": self.notes}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    @classmethod
    def from_dict(cls, d: dict) -> Strategy:
        return cls(d["name"], d["record_selector"], {k: Selector.from_dict(s) for k, s in (d.get("fields") or {}).items()}, d.get("next_page_selector"), d.get("notes") or "")

    @classmethod
    def from_json(cls, text: str) -> Strategy:
        return cls.from_dict(json.loads(text))


def default_strategy() -> Strategy:
    css = lambda value, transform="text", attr=None: Selector("css", value, attr, transform)
    # The selectors of the undamaged layout
    return Strategy(
        "default",
        "article.product-card",
        {
            "product_id": Selector("attr-on-self", "data-product-id"),
            "product_name": css("h3.product-name"),
            "price": css("span.price", "price"),
            "currency": css("span.currency"),
            "rating": css("span.rating", "rating"),
            "review_count": css("span.review-count", "int_from_text"),
            "availability": css("div.availability"),
            "product_url": css("a.product-link", "url", "href"),
            "image_url": css("img.product-image", "url", "src"),
        },
        "nav.pagination a.next",
    )


@dataclass(frozen=True)
class HealthWeights:
    completeness: float = 0.30
    validity: float = 0.30
    schema_consistency: float = 0.20
    record_consistency: float = 0.20

    def __post_init__(self) -> None:
        if not 0.99 <= self.completeness + self.validity + self.schema_consistency + self.record_consistency <= 1.01:
            raise ValueError("health weights must sum to 1")


@dataclass(frozen=True)
class HealthThresholds:
    healthy: float = 0.90
    warning: float = 0.70
    field_broken: float = 0.8
    record_collapse: float = 0.5
    low_completeness: float = 0.5
    null_spike: float = 0.30

    def __post_init__(self) -> None:
        if not 0 <= self.warning <= self.healthy <= 1:
            raise ValueError("thresholds must satisfy 0 <= warning <= healthy <= 1")
