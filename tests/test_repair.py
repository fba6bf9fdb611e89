"""Repair in one parse, and what it knows from history."""

import json

from pyspark.sql import functions as F

from mendwork.operators import dom
from mendwork.operators.candidates import templates
from mendwork.operators.history import former_selectors, former_values
from mendwork.operators.repair import probe
from mendwork.operators.schema import FIELDS, Selector, Strategy, default_strategy


def test_probe_reads_what_each_selector_finds(spark, site):
    pages = site.where("page_no = 2 AND layout IN ('v3_dataattr', 'v9_combined', 'v6_label_change')").withColumns({"broken_fields": F.array(*[F.lit(f) for f in (*FIELDS, "brand")]), "strategy": F.lit(default_strategy().to_json())})
    got = {r.layout: r for r in probe(pages, ["layout"]).collect()}
    for page in pages.collect():
        roots = list(dom.select(dom.parse(page.html), "article.product-card"))
        made = got[page.layout].candidates
        assert [r["price"].raw for r in got[page.layout].records] == [dom.first_value(r, "css", "span.price", None) for r in roots]
        for c in made:
            assert c.raws == [dom.first_value(r, c.kind, c.value, c.attr) for r in roots], c.value
        words = {c.lower() for e in dom.parse(page.html).walk() for c in e.classes} | {a for e in dom.parse(page.html).walk() for a in e.attrs}
        for f in (*FIELDS, "brand"):
            table = templates(f if f in FIELDS else "")
            want = [n for n, c in enumerate(table) if c["needs"] is None or c["needs"].lstrip(".") in words]
            assert [c.gen_ord for c in made if c.field == f] == want
    # the html is read where it lies
    rows = spark.createDataFrame([("x", "", ["price"], default_strategy().to_json())], "layout string, html string, broken_fields array<string>, strategy string")
    assert "Exchange" not in probe(rows, ["layout"])._jdf.queryExecution().executedPlan().toString()


def test_probe_of_odd_pages(spark):
    own = default_strategy().to_json()
    schema = "k int, html string, broken_fields array<string>, strategy string, more array<struct<field:string,gen_ord:int,kind:string,value:string,attr:string,transform:string,source:string,rationale:string>>"
    extra = lambda n, value, source: ("price", n, "css", value, None, "price", source, "")
    page = '<article class="product-card"><em>1</em></article>'
    rows = [(1, None, ["price"], own, None), (2, "", None, own, []), (3, page, ["price"], own, [extra(2_000_000, "em", "llm"), extra(1_000_001, "em", "historical"), extra(1_000_002, "em", "historical"), extra(1_000_003, "[data-testid='price']", "historical")])]
    rows.append((4, page, ["price"], json.dumps({"name": "n", "record_selector": "", "fields": {}}), None))
    got = {r.k: r for r in probe(spark.createDataFrame(rows, schema), ["k"], given="more").collect()}
    assert all(c.raws == [] for c in got[1].candidates) and got[2].candidates == [] and got[4].records == []
    # a former selector counts once and not beside the same one of the vocabulary; a plug-in's always
    assert [(c.gen_ord, c.raws) for c in got[3].candidates if c.gen_ord >= 1_000_000] == [(1_000_001, ["1"]), (2_000_000, ["1"])]


def test_history_as_of_the_run(spark):
    text = lambda value: Strategy("s", "article", {"price": Selector("css", value, None, "price"), "currency": Selector("static", "EUR")}).to_json()
    versions = spark.createDataFrame([(1, 1, text("a"), 10), (1, 2, text("b"), 20), (1, 3, text("a"), 30), (2, 1, text("z"), 15)], "scraper_id long, version int, strategy string, seq long")
    runs = spark.createDataFrame([(1, 20), (2, 15), (3, 99)], "scraper_id long, seq long")
    rows = lambda df: sorted((r.scraper_id, r.field, r.value, r.ord) for r in df.collect())
    assert rows(former_selectors(versions)) == [(1, "currency", "EUR", 1), (1, "price", "a", 1), (1, "price", "b", 2), (2, "currency", "EUR", 1), (2, "price", "z", 1)]
    assert rows(former_selectors(versions, runs)) == [(1, "currency", "EUR", 1), (1, "price", "a", 1)]
    cells = ", ".join(f"{f} {'double' if f in ('price', 'rating') else 'long' if f == 'review_count' else 'string'}" for f in FIELDS)
    record = lambda seq, price, loose: (1, seq, *[price if f == "price" else "EUR" if f == "currency" else None for f in FIELDS], loose)
    records = spark.createDataFrame([record(1, 1.5, {}), record(2, 1.5, {}), record(3, None, {"price": "cheap"}), record(9, 2.5, {})], f"scraper_id long, seq long, {cells}, loose map<string,string>")
    values = former_values(records, spark.createDataFrame([(1, 9)], "scraper_id long, seq long"))
    assert sorted((r.field, r.value) for r in values.collect()) == [("currency", "EUR"), ("price", "1.5"), ("price", "cheap")]
