"""Validation rules: each gives the violations of one record.

A rule is a name and a list of (field, code, condition, message) columns, so a
record's violations are one array expression; rules can be added or replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memo import memo
from .dedupe import present
from .schema import FIELDS, ID, KINDS

# Names that are labels of the page, and names that are placeholders
UI_LABELS = ("add to cart", "buy now", "wishlist", "compare", "n/a")
PLACEHOLDERS = ("n/a", "na", "null", "undefined", "unknown", "tbd", "todo", "placeholder", "sample", "example", "test", "lorem ipsum", "xxx", "???")
MARKUP = "(?i)<[a-z/][a-z0-9]*[^>]*>"
PRICE_CAP, PRICE_SENTINEL = 10_000_000, 9_999_999


@dataclass(frozen=True)
class Check:
    field: str
    code: str
    condition: Column
    message: str


@dataclass(frozen=True)
class Rule:
    name: str
    checks: tuple[Check, ...]


def _loose(field: str) -> Column:
    return F.coalesce(F.map_contains_key("loose", field), F.lit(False))


def _number(field: str, test) -> Column:
    """A test of a number; false for null and NaN."""
    value = F.col(field)
    return F.coalesce(~F.isnan(value.cast("double")) & test(value), F.lit(False))


def _text(field: str) -> Column:
    return F.coalesce(F.col(field) if field not in KINDS else F.element_at("loose", field), F.lit(""))


@memo
def default_rules() -> list[Rule]:
    name = F.lower(F.trim(_text("product_name")))
    numbers = {f: ("int" if KINDS[f] == "bigint" else "number") for f in KINDS}
    return [
        Rule("required_fields_present", tuple(Check(f, "missing", ~present(f), f"{f} is required but missing") for f in FIELDS)),
        Rule("types_match", tuple(Check(f, "wrong_type", _loose(f), f"{f} must be {numbers.get(f, 'str')}") for f in FIELDS)),
        Rule("price_plausible", (
            Check("price", "negative", _number("price", lambda v: v < 0), "price is negative"),
            Check("price", "implausibly_high", _number("price", lambda v: v > PRICE_CAP), "price exceeds the cap"),
        )),
        Rule("price_not_placeholder", (
            Check("price", "placeholder_zero", _number("price", lambda v: v == 0), "price is exactly zero"),
            Check("price", "placeholder_penny", _number("price", lambda v: v == 0.01), "price is 0.01"),
            Check("price", "placeholder_sentinel", _number("price", lambda v: v >= PRICE_SENTINEL), "price looks like a sentinel"),
        )),
        Rule("rating_in_range", (Check("rating", "out_of_range", _number("rating", lambda v: (v < 0) | (v > 5)), "rating is outside 0 to 5"),)),
        Rule("review_count_non_negative", (Check("review_count", "negative", _number("review_count", lambda v: v < 0), "review_count is negative"),)),
        Rule("urls_valid", tuple(Check(f, "invalid_url", F.coalesce(~F.col(f).rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"), F.lit(False)), f"{f} has no scheme or host") for f in ("product_url", "image_url"))),
        Rule("name_not_ui_label", (
            Check("product_name", "looks_like_ui", name.isin(*UI_LABELS), "product_name looks like a label of the page"),
            Check("product_name", "too_short", F.length(name) == 1, "product_name is too short"),
        )),
        Rule("name_not_placeholder", (Check("product_name", "placeholder_text", name.isin(*PLACEHOLDERS), "product_name looks like a placeholder"),)),
        Rule("no_html_leakage", tuple(Check(f, "html_leak", _text(f).rlike(MARKUP), f"{f} contains markup") for f in (ID, *FIELDS))),
        Rule("currency_iso_shape", (Check("currency", "not_iso4217", F.coalesce(~F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)) | _loose("currency"), "currency is not a three-letter code"),)),
    ]


def violations(rules: Sequence[Rule] | None = None) -> Column:
    """Array of (field, code, message, ord) of one record, in the order of the rules."""
    return _default_violations() if rules is None else _violations(rules)


@memo
def _default_violations() -> Column:
    return _violations(default_rules())


def _violations(rules: Sequence[Rule]) -> Column:
    checks = [c for r in rules for c in r.checks]
    entries = [F.when(c.condition, F.struct(F.lit(c.field).alias("field"), F.lit(c.code).alias("code"), F.lit(c.message).alias("message"), F.lit(i).alias("ord"))) for i, c in enumerate(checks)]
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def validate(records: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Records with their ``violations``; a column of that name is replaced."""
    return records.withColumn("violations", violations(rules))


def violation_rows(records: DataFrame, keys: Sequence[str], rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per violation: keys, pos, field, code, message."""
    return records.select(*keys, "pos", F.explode(violations(rules)).alias("v")).select(*keys, "pos", "v.field", "v.code", "v.message")
