"""Layout generator: product pages in eleven layouts from any product frame.

A layout is the undamaged card with a few slots changed; a page is ten cards
between a head and a pagination. All of it is column expressions, so pages can
be generated at any scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.memo import memo

PAGE_SIZE = 10
# What a card shows
_CARD = ("product_id", "product_name", "price", "currency", "rating", "review_count", "availability", "product_url", "image_url")

#: the layouts and whether the default strategy breaks on them
LAYOUTS = {
    "v1_healthy": False, "v2_rename_class": True, "v3_dataattr": True, "v4_change_nesting": False, "v5_move_price": False, "v6_label_change": False,
    "v7_decoy": False, "v8_pagination": False, "v9_combined": True, "v10_partial": True, "v11_semantic": False,
}


def escaped(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def _tag(name: str, mark: str, *inner: Column | str) -> Column:
    attr = f" {mark}" if mark else ""
    return F.concat(F.lit(f"<{name}{attr}>"), *[F.lit(i) if isinstance(i, str) else i for i in inner], F.lit(f"</{name}>"))


def card(layout: str, of: Callable[[str], Column] = F.col) -> Column:
    """One product card; ``of`` gives the fields of the record schema, all non-null."""
    testid, nested, decoy = layout == "v3_dataattr", layout in ("v4_change_nesting", "v9_combined"), layout in ("v7_decoy", "v9_combined")
    mark = lambda cls, test=None: f'data-testid="{test or cls}"' if testid else f'class="{cls}"'
    cost = "cost" if layout in ("v2_rename_class", "v9_combined") else "price"
    money = lambda v: F.concat(F.lit("₹"), F.format_number(v, 2))
    label = layout == "v6_label_change"
    price = _tag("span", mark(f"{cost} current" if decoy else cost, "price"), money(of("price")))
    was = [_tag("s", f'class="{cost} original"', money(of("price") * 1.25))] if decoy else []
    currency = _tag("span", mark("currency"), escaped(of("currency")))
    rating = _tag("span", mark("rating"), F.format_string("%.1f", of("rating")))
    reviews = _tag("span", mark("review-count"), F.format_number(of("review_count"), 0))
    stock = of("availability")
    if layout == "v11_semantic":
        stock = F.when(stock == "In Stock", "Available").otherwise("Unavailable")
    wrap = (lambda cls, x: _tag("div", f'class="{cls}"', x)) if nested else (lambda cls, x: x)
    image = F.concat(F.lit('<img class="product-image" src="'), escaped(of("image_url")), F.lit('" alt="'), escaped(of("product_name")), F.lit('">'))
    link = F.concat(F.lit('<a class="product-link" href="'), escaped(of("product_url")), F.lit('">'), wrap("media", image), wrap("title-wrap", _tag("h3", mark("product-name", "title"), escaped(of("product_name")))), F.lit("</a>"))
    block = "" if testid else 'class="price-block"'
    prices = F.concat(F.lit("Buy for ") if label else F.lit(""), *was, price, F.lit(" "), currency)
    prices = _tag("aside", 'class="summary"', prices) if layout == "v5_move_price" else _tag("div", block, wrap("inner", prices))
    rated = F.concat(F.lit("Rated ") if label else F.lit(""), rating, F.lit("/5 · ") if label else F.lit(" stars · "), reviews, F.lit(" ratings") if label else F.lit(" reviews"))
    rates = _tag("div", "" if testid else 'class="rating-block"', wrap("inner", rated))
    said = F.concat(F.lit("Availability: ") if label else F.lit(""), escaped(stock))
    stocks = _tag("div", 'class="stock-status"' if layout == "v10_partial" else mark("availability"), _tag("span", 'class="inner"', said) if nested else said)
    body = F.concat(link, wrap("body", F.concat(prices, rates, stocks)))
    return F.concat(F.lit('<article class="product-card" data-product-id="'), escaped(of("product_id")), F.lit('">'), wrap("card-inner", body), F.lit("</article>\n"))


@memo
def _cards(layout: str) -> Column:
    """The cards of a page's products in ``_products``, one after the other."""
    return F.array_join(F.transform("_products", lambda p: card(layout, lambda f: p[f])), "")


@memo
def _pagination(layout: str) -> Column:
    page, total = F.col("page_no"), F.col("_pages")
    numbers = F.sequence(F.lit(1), total)
    if layout == "v8_pagination":
        links = F.transform(numbers, lambda n: F.concat(F.lit('<a data-p="'), n.cast("string"), F.lit('" href="?p='), n.cast("string"), F.lit('">'), n.cast("string"), F.lit("</a>")))
        more = F.when(page < total, F.concat(F.lit('<button class="load-more" data-next="'), (page + 1).cast("string"), F.lit('">Show more</button>'))).otherwise("")
        return _tag("div", 'class="pager"', F.array_join(links, ""), more)
    links = F.transform(numbers, lambda n: F.concat(F.lit('<a class="'), F.when(n == page, "current").otherwise("page"), F.lit('" href="?page='), n.cast("string"), F.lit('">'), n.cast("string"), F.lit("</a>")))
    step = lambda cls, n, shown: F.when(shown, F.concat(F.lit(f'<a class="{cls}" href="?page='), n.cast("string"), F.lit(f'">{cls}</a>'))).otherwise("")
    return _tag("nav", 'class="pagination"', step("prev", page - 1, page > 1), F.array_join(links, ""), step("next", page + 1, page < total))


def pages(products: DataFrame, site: list[str] | None = None, layouts: list[str] | None = None, url: str = "http://127.0.0.1:8765/list") -> DataFrame:
    """Pages of ten products: site columns, layout, page_no, url, html.

    ``products`` has the record schema and a place ``pos`` from 0 within each
    site. A page's cards are gathered by page, ten at most.
    """
    site = site or []
    chosen = layouts or list(LAYOUTS)
    # products are dealt once, by site, to as many tasks as shuffles have: rows are few and small here, but each makes cards and pages
    tasks = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    page_no = (F.floor(F.col("pos") / PAGE_SIZE) + 1).cast("int").alias("page_no")
    rows = products.select(*site, "pos", page_no, *[F.col(f) for f in _CARD]).repartition(tasks, *(site or ["page_no"]))
    page = rows.groupBy(*site, "page_no").agg(F.array_sort(F.collect_list(F.struct("pos", *_CARD))).alias("_products"))
    if site:
        page = page.withColumn("_pages", F.max("page_no").over(Window.partitionBy(*site)))
    else:
        page = page.crossJoin(F.broadcast(products.agg(F.ceil((F.max("pos") + 1) / PAGE_SIZE).cast("int").alias("_pages"))))
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("layout"), _cards(n).alias("body"), _pagination(n).alias("foot")) for n in chosen])).alias("c")
    head = F.concat(F.lit('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Catalog</title></head><body><header><h1>Shop</h1></header><main><h2>Page '), F.col("page_no").cast("string"), F.lit('</h2><section class="product-grid">\n'))
    html = F.concat(head, F.col("c.body"), F.lit("</section>\n"), F.col("c.foot"), F.lit("</main><footer><p>Synthetic data.</p></footer></body></html>\n"))
    return page.select(*site, "page_no", made).select(*site, "c.layout", "page_no", F.lit(url).alias("url"), html.alias("html"))
