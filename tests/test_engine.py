import duckdb
import pytest
from pyspark.sql import functions as F

from mendwork.operators import dom
from mendwork.operators.candidates import templates
from mendwork.operators.dedupe import dedupe
from mendwork.operators.detect import detect
from mendwork.operators.extract import extract
from mendwork.operators.health import broken_fields, health
from mendwork.operators.schema import HealthThresholds, HealthWeights, Selector, Strategy, default_strategy
from mendwork.plans.session import Session
from mendwork.sources.layouts import LAYOUTS
from mendwork.sources.pages import PageStore, ProviderUnavailable, ProxySource

BASE = "http://127.0.0.1:8765"


@pytest.fixture(scope="session")
def reports(site):
    records = extract(site, default_strategy(), ["layout", "page_no"]).records.cache()
    return health(records, ["layout"], 20).cache(), records


def test_layout_health_matches_published_rows(reports):
    got = {r.layout: (r.completeness, r.validity, r.health_score, r.status, r["b"]) for r in reports[0].select("*", broken_fields().alias("b")).collect()}
    assert {k for k, v in got.items() if v[3] != "healthy"} == {k for k, broken in LAYOUTS.items() if broken}
    assert got["v2_rename_class"] == (0.875, 0.0, 0.6625, "repair_required", ["price"])
    assert got["v3_dataattr"][:4] == (0.25, 0.0, 0.475, "repair_required") and len(got["v3_dataattr"][4]) == 6
    assert got["v1_healthy"] == (1.0, 1.0, 1.0, "healthy", [])


def test_detection_matches_labels(reports):
    report = reports[0]
    found = {r.layout: (r.detected, r.severity) for r in detect(report, report.where("layout = 'v1_healthy'"), ["layout"]).collect()}
    assert found == {k: (broken, "critical" if broken else "none") for k, broken in LAYOUTS.items()}


def test_extracted_records_equal_products(reports, products):
    rows = reports[1].where("layout = 'v6_label_change'").select("product_id", "product_name", "price", "rating", "review_count", "availability", "product_url")
    assert sorted(rows.collect()) == sorted(products.select(*rows.columns).collect())


def test_candidate_templates():
    assert len([c for c in templates("price") if c["needs"] is None]) == 16 + 3 + 8
    assert templates("product_url")[0] == {"kind": "css", "value": "[data-testid='product-link']", "attr": "href", "transform": "url", "source": "attr", "rationale": "data-testid is product-link", "needs": None}


def test_run_repairs_and_rolls_back(spark, site, products, tmp_path):
    source = PageStore(site.select("layout", "page_no", "html"))
    session = Session(spark, str(tmp_path), source)
    scraper = session.register("shop", f"{BASE}/list")
    assert session.register("shop", f"{BASE}/list") == scraper
    assert session.run(scraper, f"{BASE}/list?page=1", 10)[1].action == "no_change"
    source.switch("v2_rename_class")
    decision = session.run(scraper, f"{BASE}/list?page=1", 10, products)[1]
    assert (decision.action, decision.new_version, decision.confidence) == ("promote", 2, 0.925)
    assert session.active_strategy(scraper).fields["price"].value in (".cost", "span.cost")
    assert session.rollback(scraper, 1).action == "rollback"
    assert session.scraper(scraper).current_version == 1
    with pytest.raises(LookupError):
        session.rollback(scraper, 9)
    events = session.history(scraper)["repair_events"].collect()
    assert [e.action for e in events] == ["rollback", "promote"] and events[1].candidate_count == 5
    assert session.history(scraper)["versions"].count() == 2
    with pytest.raises(FileNotFoundError):
        source.require(spark.createDataFrame([("http://x/list?page=99",)], "url string"))


def test_dom_and_selectors():
    root = dom.parse('<div id=a><p class="x y">one<p data-k="v">two<ul><li>1<li>2</ul><script>var t="</p>"</script></div>')
    texts = lambda s: [e.text() for e in dom.select(root, s)]
    assert texts("p") == ["one", "two"] and texts("div > p.x") == ["one"] and texts("[data-k='v']") == ["two"]
    assert texts("li:nth-of-type(2)") == ["2"] and texts("p + p") == ["two"] and texts("p.x, li") == ["one", "1", "2"] and texts("p:::") == []
    assert dom.first_value(next(dom.select(root, "div")), "xpath", ".//p[@data-k]/text()", None) == "two"
    assert dom.first_value(root, "text-anchor", "one", None) is not None
    assert list(dom.parse(None).walk()) == []


def test_fold_is_ordered(spark):
    schema = "page int, pos int, product_id string, product_name string, price double, currency string, rating double, review_count bigint, availability string, product_url string, image_url string, loose map<string,string>"
    row = lambda pos, **k: (1, pos, *[{"product_id": "A", **k}.get(f) for f in ("product_id", "product_name", "price", "currency", "rating", "review_count", "availability", "product_url", "image_url")], {})
    rows = [row(0, product_name="a", price=1.0), row(1, currency="X"), row(2, product_name="b", price=2.0, currency="Y"), row(3, product_id=None)]
    unique, report = dedupe(spark.createDataFrame(rows, schema), ["page"])
    got = unique.first()
    assert (got.product_name, got.price, got.currency) == ("a", 1.0, "X")
    assert report.select("input_count", "output_count", "dropped_no_key", "merged_duplicates").first() == (4, 1, 1, 2)
    assert dedupe(spark.createDataFrame([], schema), ["page"])[0].count() == 0


def test_wrong_types_are_violations(spark):
    page = "<article class=product-card data-product-id=1><span class=price>cheap</span></article>"
    strategy = default_strategy()
    fields = dict(strategy.fields) | {"price": Selector("css", "span.price")}
    got = extract(spark.createDataFrame([("http://s/1", page), ("http://s/2", None)], "url string, html string"), Strategy("t", strategy.record_selector, fields))
    assert got.records.select("loose").first().loose == {"price": "cheap"}
    report = health(got.records, ["url"], 1).first()
    assert report.violations_by_code["wrong_type"] == 1 and report.schema_consistency == 0.0 and got.pages.count() == 2


def test_configuration_errors(spark):
    with pytest.raises(ValueError):
        HealthWeights(completeness=0.9)
    with pytest.raises(ValueError):
        HealthThresholds(healthy=0.5, warning=0.8)
    with pytest.raises(ProviderUnavailable):
        ProxySource("").fetch(None)
    assert Strategy.from_json(default_strategy().to_json()) == default_strategy()


QUICK = ["price_parse", "rating_parse", "int_parse", "url_canonical", "url_dup_groups", "tracking_param_stats", "rule_violations", "violations_by_code", "health_status", "failure_signals", "dedupe_fold", "dedupe_report", "newly_broken", "layout_health", "scraper_state", "rollback_state", "golden_accuracy", "page_facts", "page_select", "dom_fingerprints", "page_vocabulary", "anchor_values", "paginated_runs", "detection_as_of", "repair_winners", "variant_violations", "snapshot_files"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_sql(spark, name):
    import __spark_entry__ as entry

    QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("part", "events", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    order = [[d[0] for d in want.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
