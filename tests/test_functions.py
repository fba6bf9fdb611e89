import pytest
from pyspark.sql import functions as F

from mendwork.functions import normalize as N
from mendwork.functions import urls as U


def values(spark, parse, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.v for r in rows.select("i", parse("x").alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("parse", "pairs"),
    [
        (N.parse_price, {"$1,299.00": 1299.0, "1.299,50 EUR": 1299.5, "-50": None, "Buy for ₹ 8,999.00 INR": 8999.0, "Free!": None, "12,50": 12.5, "1.2.3": None, "AB-1001 ₹5": None, "": None}),
        (N.parse_currency, {"₹8,999.00": "INR", "$1": "USD", "1 €": "EUR", "chf": "CHF", "none at all": None}),
        (N.parse_rating, {"4.5": 4.5, "Rated 4.5/5": 4.5, "8/10": 4.0, "90/100": 4.5, "bogus": None, "101": None}),
        (N.parse_int, {"1,284": 1284, "5,210 reviews": 5210, "none": None, "-5": None, "3.9": 3}),
        (N.parse_availability, {"In Stock": "In Stock", "Availability: Available": "In Stock", "Unavailable": "Out of Stock", "Notify me": "Out of Stock", "Soon": "Soon", " ": None}),
        (N.parse_text, {"  a \t b ": "a b", " ": None}),
        (N.parse_float, {"1e3": 1000.0, "1_000": None, "1.0d": None, "8.": 8.0}),
    ],
)
def test_normalizers(spark, parse, pairs):
    assert values(spark, parse, list(pairs)) == list(pairs.values())
    assert values(spark, parse, [None]) == [None]


def test_urls(spark):
    got = values(spark, U.canonical, ["http://X.com/p/1?utm_source=abc&sku=42&gclid=Z", "HTTP://x.com/a/?b=2&a=1#t", "", None])
    assert got == ["http://x.com/p/1?sku=42", "http://x.com/a/?a=1&b=2", None, None]
    base = F.lit("http://s.example:1")
    got = values(spark, lambda c: U.resolve(c, base), ["/p/1", "http://a/b", "//h/x", "q?z=1", "../up", " "])
    assert got == ["http://s.example:1/p/1", "http://a/b", "http://h/x", "http://s.example:1/q?z=1", "http://s.example:1/up", None]
    joined = values(spark, lambda c: U.join(F.lit("http://s/list?page=1"), c), ["?page=2", "3", "#x"])
    assert joined == ["http://s/list?page=2", "http://s/3", "http://s/list?page=1#x"]
