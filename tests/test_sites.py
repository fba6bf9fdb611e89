"""Pagination, the node table, detection as of a run, fleets and the state log."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mendwork.operators import dom, nodes
from mendwork.operators.detect import baseline_as_of, detect, detect_as_of
from mendwork.operators.extract import extract, facts
from mendwork.operators.paginate import MAX_PAGES, extract_all, follow
from mendwork.operators.repair import proposed, proposed_json
from mendwork.operators.schema import FIELDS, Selector, Strategy, default_strategy
from mendwork.plans import fleet
from mendwork.sources.log import EVENT, ConcurrentWrite, StateLog

# ---- pagination


def plain_way(links, start, most=MAX_PAGES):
    seen, at = [], start
    while at is not None and at not in seen and len(seen) < most:
        if at not in links:
            return seen, "missing"
        seen.append(at)
        at = links[at]
    return seen, "end" if at is None else "repeat" if at in seen else "limit" if at in links or len(seen) >= most else "missing"


def test_ways_against_a_loop(spark):
    rng = random.Random(3)
    sites = {}
    for site in range(40):
        names = [f"p{k}" for k in range(rng.randint(1, 45))]
        links = {n: m for n, m in zip(names, names[1:] + [None])}
        for _ in range(rng.choice((0, 0, 1, 2))):
            links[rng.choice(names)] = rng.choice([*names, "gone", None])
        sites[site] = links
    rows = [(s, n, m) for s, links in sites.items() for n, m in links.items()]
    got = follow(spark.createDataFrame(rows, "site int, url string, next_page_url string"), ["site"])
    assert {(r.site, r.url): (r.pages, r.stopped) for r in got.collect()} == {(s, n): plain_way(links, n) for s, links in sites.items() for n in links}
    few = follow(spark.createDataFrame(rows, "site int, url string, next_page_url string"), ["site"], max_pages=3)
    assert {(r.site, r.url): r.pages for r in few.collect()} == {(s, n): plain_way(links, n, 3)[0] for s, links in sites.items() for n in links}


def shop(n, link):
    cards = "".join(f'<article class="product-card" data-product-id="{n}-{k}"><h3 class="product-name">Thing {n}</h3></article>' for k in (1, 1, 2))
    return f'<html><body class="n{n}">{cards}<nav class="pagination">{link}</nav></body></html>'


def test_pages_are_joined_in_order(spark):
    link = lambda n: f'<a class="next" href="?page={n}">next</a>'
    pages = [("long", k, shop(k, link(k + 1))) for k in range(1, 24)] + [("ring", k, shop(k, link(k % 3 + 1))) for k in (1, 2, 3)]
    pages += [("dead", 1, shop(1, link(2))), ("dead", 2, shop(2, link(9))), ("bare", 1, "<p>nothing"), ("null", 1, None)]
    frame = spark.createDataFrame([(s, f"http://{s}/list?page={k}", h, 1) for s, k, h in pages], "site string, url string, html string, hop int")
    starts = spark.createDataFrame([(s, f"http://{s}/list?page=1") for s in ("long", "ring", "dead", "bare", "null", "none")] * 2, "site string, url string")
    got = extract_all(frame, starts, default_strategy(), ["site"])
    runs = {r.site: r for r in got.runs.collect()}
    assert {s: (r.n_pages, r.stopped, r.raw_len) for s, r in runs.items()} == {
        "long": (20, "limit", 40), "ring": (3, "repeat", 6), "dead": (2, "missing", 4), "bare": (1, "end", 0), "null": (1, "end", 0), "none": (0, "missing", 0),
    }
    assert "body.n20=1" in runs["long"].fingerprint and runs["none"].fingerprint is None
    rows = [(r.place, r.hop, r.product_id) for r in got.records.where("site = 'long'").orderBy("place").collect()]
    # the doubled card goes within its page; the pages follow each other
    assert rows == [(2 * k + j, k, f"{k + 1}-{j + 1}") for k in range(20) for j in range(2)]
    empty = extract_all(frame.limit(0), starts.limit(0), default_strategy(), ["site"])
    assert empty.records.count() == 0 and empty.runs.count() == 0


# ---- nodes

HTML = """<div id=a><p class="x y">one<p data-k="v">two<ul class=x><li>1<li class="Y">2<ul><li>deep</ul></ul><script>var t="</p>"</script></div>
<table><tr><td>Price: <b>10</b> <i></i>eur<td>n</table><section><p>three<br>four <a href=/q>link</a></p></section><h1> T &amp; U\xa0 </h1>"""
SELECTORS = ["p", "div p.x", "div > p", "ul li", "ul > li", ".x li.Y", "li:nth-of-type(2)", "[data-k]", "[data-k='v']", "p, li", "ul ul li", "#a .x", "p.x.y", "*", "p + p", "p:::", "> p", "ul >", "", "a[href='/q']", "div  ul   li", "td b, h1"]


def test_selectors_against_the_tree(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "text only"), (5, "</p><b>open")], "page int, html string")
    table = nodes.nodes(pages, ["page"]).cache()
    names = {f"s{n}": s for n, s in enumerate(SELECTORS)}
    rows = nodes.matched(table, ["page"], names).where("page = 1 AND node > 0 AND tag IS NOT NULL").orderBy("node").collect()
    every = list(dom.parse(HTML).walk())
    assert [r.tag for r in rows] == [e.tag for e in every]
    beyond = {"p + p", "p:::", "> p", "ul >", ""}  # not in the grammar here: nothing matches
    for n, s in names.items():
        want = set() if s in beyond else {k for k, e in enumerate(every) if any(dom._fits(e, steps) for steps in dom.compiled(s))}
        assert {k for k, r in enumerate(rows) if r[n]} == want, s
    texts = table.join(nodes.documents(table, ["page"]).withColumnRenamed("texts", "_t"), "page").where("page = 1 AND node > 0 AND tag IS NOT NULL AND tag <> 'script'").orderBy("node").select(nodes.text_of(texts="_t").alias("t"))
    assert [r.t for r in texts.collect()] == [e.text() for e in every if e.tag != "script"]
    spans = table.where("page = 1 AND node > 0").select("node", "parent", "last").collect()
    assert all(r.parent < r.node <= r.last for r in spans)
    assert {r.page: r.n for r in table.groupBy("page").agg(F.count("*").alias("n")).collect()} == {1: table.where("page = 1").count(), 2: 1, 3: 1, 4: 2, 5: 3}
    prints = {r.page: r.fingerprint for r in nodes.fingerprints(table, ["page"]).collect()}
    assert prints == {n: dom.fingerprint(dom.parse(h)) for n, h in ((1, HTML), (2, None), (3, ""), (4, "text only"), (5, "</p><b>open"))}
    words = nodes.vocabulary(table, ["page"]).where("page = 1").first()
    assert (words.classes, words.data_attrs) == (["x", "y"], ["data-k"])


def test_values_against_extraction(spark, site):
    """The same raw values as the tree gives, on all layouts, by the selectors of strategies and candidates."""
    fields = dict(default_strategy().fields) | {"cost": Selector("css", ".cost"), "price_anchor": Selector("text-anchor", "Buy for"), "rated": Selector("text-anchor", "rating"), "fixed": Selector("static", "x"), "second": Selector("css", "span:nth-of-type(2)"), "test": Selector("css", "[data-testid='price']")}
    strategy = Strategy("all", "article.product-card", fields)
    pages = site.where("page_no = 2").select("layout", "html")
    got = nodes.raw_values(nodes.nodes(pages, ["layout"]), ["layout"], strategy)
    found = {(r.layout, r.pos): tuple(r[f] for f in fields) for r in got.collect()}
    want = {}
    for r in pages.collect():
        for pos, record in enumerate(facts(r.html, strategy)["records"]):
            want[r.layout, pos] = tuple(v["raw"] for _, v in record)
    assert found == want and len(found) == 110


def test_nested_roots(spark):
    page = "<div class=r>a<div class=r><b>1</b></div><b>2</b></div><div class=r></div><div><b>3</b></div>"
    got = nodes.raw_values(nodes.nodes(spark.createDataFrame([(1, page)], "p int, html string"), ["p"]), ["p"], Strategy("n", "div.r", {"b": Selector("css", "b")}))
    assert [r.b for r in got.orderBy("pos").collect()] == ["1", "1", None]


# ---- detection as of a run


@pytest.mark.parametrize("span", [1, 5, 65_536])
def test_baseline_is_the_last_good_run_before(spark, span):
    rng = random.Random(span)
    rows = [(s, n * rng.choice((1, 3)) + 100 * n, rng.choice(["healthy", "warning", "repair_required"]), round(rng.random(), 2)) for s in range(4) for n in range(25)]
    frame = spark.createDataFrame(rows, "scraper int, run long, status string, health_score double").withColumns({"records_received": F.col("run"), "null_rates": F.create_map(F.lit("price"), F.col("health_score")), "failure_signals": F.array().cast("array<string>")})
    got = {(r.scraper, r.run): r.baseline and r.baseline.run for r in baseline_as_of(frame, ["scraper"], "run", span).collect()}
    assert got == {(s, n): max((m for t, m, status, _ in rows if t == s and m < n and status == "healthy"), default=None) for s, n, _, _ in rows}
    reports = {(r.scraper, r.run): r for r in detect_as_of(frame, ["scraper"], "run", span).collect()}
    for s, n, _, _ in rows[::9]:
        base = frame.where((F.col("scraper") == s) & (F.col("run") == (-1 if got[s, n] is None else got[s, n])))
        one = detect(frame.where((F.col("scraper") == s) & (F.col("run") == n)), None if got[s, n] is None else base, ["scraper"], None if got[s, n] is None else ["scraper"]).first()
        assert (one.severity, one.confidence, one.reason, one.evidence) == tuple(reports[s, n][c] for c in ("severity", "confidence", "reason", "evidence"))


# ---- fleets


def test_proposed_strategies(spark):
    repairs = [("price", "css", ".cost", None, "price", "promote"), ("rating", "css", "b", "x", "rating", "shadow"), ("currency", None, None, None, None, "reject"), ("extra", "static", "1", None, "text", "promote")]
    schema = "array<struct<field:string,kind:string,value:string,attr:string,transform:string,action:string>>"
    row = spark.createDataFrame([(default_strategy().to_json(), repairs)], f"s string, r {schema}").select(proposed_json("s", "r").alias("p"), "r").first()
    want = proposed(default_strategy(), [r.asDict() for r in row.r])
    assert Strategy.from_json(row.p) == want and list(json.loads(row.p)["fields"]) == list(want.fields)


def test_fleet_mixed_outcomes(spark, site, products):
    rows = [(n, layout) for n, layout in enumerate(("v1_healthy", "v2_rename_class", "v10_partial", "v1_healthy", "v2_rename_class"))]
    numbered = spark.createDataFrame(rows, "scraper_id long, layout string")
    pages = site.where("page_no = 1").join(numbered, "layout").select("scraper_id", "url", F.when(F.col("scraper_id") == 3, F.lit("<p>empty")).otherwise(F.col("html")).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(99, "http://x", "<p>")], "scraper_id long, url string, html string"))
    scrapers = numbered.unionByName(spark.createDataFrame([(7, "no page")], "scraper_id long, layout string")).select("scraper_id", F.lit(2).alias("current_version"), F.lit(4).alias("max_version"), F.lit(default_strategy().to_json()).alias("strategy"), F.lit(10).alias("expected"))
    golden = products.where("pos < 10").crossJoin(spark.range(5).withColumnRenamed("id", "scraper_id")).withColumn("price", F.when(F.col("scraper_id") == 4, 1.0e6).otherwise(F.col("price")))
    run = fleet.run_all(pages, scrapers, golden)
    got = {r.scraper_id: r for r in run.decisions.collect()}
    assert {k: (r.action, r.new_version, r.confidence) for k, r in got.items()} == {
        0: ("no_change", 2, 1.0), 1: ("promote", 5, 0.925), 2: ("promote", 5, 0.925), 3: ("reject", None, 0.0), 4: ("shadow", None, 0.775), 7: ("reject", None, 0.0),
    }
    assert got[1].reason == "shadow health 1.00 passes gate" and got[4].reason == "shadow health 1.00: not promoted (needs >= 0.9)" and got[7].failure_reason == "no_records_extracted,record_count_collapse:0/10,low_completeness:0.00"
    assert json.loads(got[1].selected)["value"] in (".cost", "span.cost") and got[4].selected is None and got[4].candidate_count == 5
    records = extract(pages.where("scraper_id = 1").withColumn("s", F.lit(got[1].strategy)), "s", ["scraper_id"]).records
    assert records.where("price IS NULL").count() == 0 and records.count() == 10
    assert run.reports.count() == 6 and run.decisions.columns[0] == "scraper_id"


# ---- the log


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "kind string, scraper_id long, n int, version int, strategy string, health_score double, status string, name string")


def test_log_of_versions_and_rollbacks(spark, tmp_path):
    log = StateLog(spark, str(tmp_path), fan=2)
    row = lambda kind, i, n, version=None, strategy=None, name=None: (kind, i, n, version, strategy, None, None, name)
    first = log_rows(spark, [row("register", 1, 0, name="shop"), row("version", 1, 1, strategy="a"), row("deploy", 1, 2), row("version", 1, 4, strategy="b"), row("deploy", 1, 3), row("rollback", 1, 5, 9)])
    assert log.append("one", first, ["n"]) and not log.append("one", first, ["n"])
    state = log.state().first()
    # the deployment stands before the second version; the unknown version is refused
    assert (state.current_version, state.max_version, state.name, state.status, log.events().count()) == (1, 2, "shop", "unknown", 6)
    assert [(r.seq, r.refused) for r in log.events("rollback").collect()] == [(6, True)]
    for n in range(6):
        events = log_rows(spark, [row("version", 1, 0, strategy=f"s{n}"), row("deploy", 1, 1), ("run", 1, 2, None, None, n / 10, "warning", None), row("version", 2 + n, 3, strategy="x"), row("rollback", 1, 4, 1 if n == 5 else None)])
        assert log.append(f"more-{n}", events, ["n"])
        assert not log.append("one", first, ["n"])  # also once the batch is in a segment
    state = {r.scraper_id: r for r in log.state().collect()}
    assert (state[1].current_version, state[1].max_version, state[1].health_score, state[1].n_runs) == (1, 8, 0.5, 6) and state[7].max_version == 1 and state[7].current_version is None
    assert sorted(r.seq for r in log.events().collect()) == list(range(1, 37))
    assert [r.strategy for r in log.strategies().where("scraper_id = 1").orderBy("version").collect()] == ["a", "b", *(f"s{n}" for n in range(6))]
    assert [(r.scraper_id, r.strategy) for r in log.active().collect()] == [(1, "a")]
    old = log.manifest()
    with pytest.raises(ConcurrentWrite):
        log._commit(old, old)
    assert StateLog(spark, str(tmp_path / "new")).state().count() == 0


def test_many_runs_leave_few_files(spark, tmp_path):
    log = StateLog(spark, str(tmp_path), fan=3)
    for n in range(10):
        runs = spark.range(1000).select(F.lit("run").alias("kind"), (F.col("id") % 50).alias("scraper_id"), (F.col("id") / 1000).alias("health_score"), F.lit("healthy").alias("status"), "id")
        assert log.append(f"runs-{n}", runs, ["id"])
    assert log.events("run").count() == 10_000 and log.state().agg(F.sum("n_runs")).first()[0] == 10_000
    held = log.manifest()
    assert len(held["tail"]) + len(held["segments"]) <= 5
    assert len([p for p in tmp_path.rglob("*.parquet")]) < 60 and len([p for p in (tmp_path / "manifests").iterdir() if p.name.isdigit()]) <= 2
    assert len(EVENT.split(", ")) == 21 and set(FIELDS)
