"""Value normalizers as Spark columns.

All of them are built-in expressions, so they run inside generated code. Digits
and letters of patterns are ASCII; white space is Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which text names which currency, first match wins
CURRENCIES = (
    ("₹", "INR"), ("RS.", "INR"), ("INR", "INR"), ("$", "USD"), ("US$", "USD"), ("USD", "USD"),
    ("€", "EUR"), ("EUR", "EUR"), ("£", "GBP"), ("GBP", "GBP"), ("¥", "JPY"), ("JPY", "JPY"),
)

# Availability wordings, the longest first
AVAILABILITY = (
    ("out of stock", "Out of Stock"), ("unavailable", "Out of Stock"), ("available", "In Stock"), ("backorder", "Backorder"),
    ("in stock", "In Stock"), ("preorder", "Preorder"), ("yes", "In Stock"), ("no", "Out of Stock"),
)

NUMBER = r"[-+]?\d[\d,\.]*"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _first(text: Column, choices: tuple[tuple[str, str], ...]) -> Column:
    (key, value), *rest = choices
    return reduce(lambda c, kv: c.when(F.contains(text, F.lit(kv[0])), kv[1]), rest, F.when(F.contains(text, F.lit(key)), value))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x`` with ``x`` evaluated once, so that plans stay small however often it is used."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def some(x: Column) -> Column:
    """Null for the empty text."""
    return F.when(x != "", x)


def clean(x: Column | str) -> Column:
    """Runs of white space as one space, trimmed; null as ''."""
    return F.coalesce(F.trim(F.regexp_replace(_col(x).cast("string"), r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def parse_text(x: Column | str) -> Column:
    """Cleaned text; null if nothing is left."""
    return let(clean(x), some)


def _number(x: Column | str) -> Column:
    return F.regexp_extract(clean(x), NUMBER, 0)


def parse_price(x: Column | str) -> Column:
    """First number as a price: of comma and point the later one is the decimal mark.

    A lone comma is decimal in forms as 12,50 and groups thousands otherwise.
    Null if there is no number, it cannot be read or it is negative; a later
    number is never tried.
    """

    def plain(n: Column) -> Column:
        comma, point = F.contains(n, F.lit(",")), F.contains(n, F.lit("."))
        tail = F.reverse(n)
        comma_last = F.instr(tail, ",") < F.instr(tail, ".")
        swapped = F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        bare = F.replace(n, F.lit(","), F.lit(""))
        return (
            F.when(comma & point, F.when(comma_last, swapped).otherwise(bare))
            .when(comma, F.when(n.rlike(r"^\d{1,3},\d{2}$"), F.replace(n, F.lit(","), F.lit("."))).otherwise(bare))
            .otherwise(n)
        )

    return let(let(_number(x), plain).try_cast("double"), lambda v: F.when(v >= 0, v))


def parse_currency(x: Column | str) -> Column:
    """ISO code named by a symbol or code in the text; else a text of three letters in upper case."""
    return let(F.upper(clean(x)), lambda t: F.coalesce(_first(t, CURRENCIES), F.when(t.rlike(r"^[A-Z]{3}$"), t)))


def parse_rating(x: Column | str) -> Column:
    """First unsigned number on a scale of 5: (5,10] is halved, (10,100] divided by 20."""
    v = F.regexp_extract(clean(x), r"\d+(\.\d+)?", 0).try_cast("double")
    return let(v, lambda v: F.when(v <= 5, v).when(v <= 10, v / 2).when(v <= 100, v / 20))


def parse_int(x: Column | str) -> Column:
    """First number without commas, cut at the first point; negative or beyond 64 bits: null."""
    v = F.substring_index(F.replace(_number(x), F.lit(","), F.lit("")), ".", 1).try_cast("bigint")
    return let(v, lambda v: F.when(v >= 0, v))


def parse_float(x: Column | str) -> Column:
    """The whole text as a number; forms that only one platform reads are null."""
    number = r"(?i)^[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?$|^[-+]?(nan|inf|infinity)$"
    return let(clean(x), lambda t: F.when(t.rlike(number), t.try_cast("double")))


def parse_availability(x: Column | str) -> Column:
    """Stock status named in the text (after a first colon, if any); else the cleaned text; blank: null."""

    def status(t: Column) -> Column:
        said = F.when(F.contains(t, F.lit(":")), F.trim(F.substr(t, F.instr(t, ":") + 1))).otherwise(t)
        return F.when(t != "", F.coalesce(let(F.lower(said), lambda low: _first(low, AVAILABILITY)), t))

    return let(clean(x), status)


def float_text(v: Column) -> Column:
    """A double as text without an exponent below 1e16, always with a decimal point."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e16)
    return F.when(whole, F.concat(v.cast("bigint").cast("string"), F.lit(".0"))).otherwise(v.cast("string"))


#: transforms whose values are whole numbers, other numbers, and text
INTS, FLOATS = ("int", "int_from_text"), ("price", "rating", "float")


def number_of(raw: Column, transform: Column) -> Column:
    """The double that a float-valued transform gives."""
    return F.when(transform == "price", parse_price(raw)).when(transform == "rating", parse_rating(raw)).when(transform == "float", parse_float(raw))


def text_of(raw: Column, transform: Column, base: Column, field: str) -> Column:
    """The text that a text-valued transform gives; unknown transforms read availability by field name."""
    from .urls import resolve

    other = parse_availability(raw) if field == "availability" else parse_text(raw)
    return (
        F.when(transform.isin("text", "attr"), parse_text(raw))
        .when(transform == "url", resolve(raw, base))
        .when(transform == "html", raw)
        .when(~transform.isin(*INTS, *FLOATS), other)
    )
