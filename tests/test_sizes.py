"""What decides time and memory on large tables."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from mendwork.functions import html as markup
from mendwork.operators import nodes
from mendwork.operators.extract import extract
from mendwork.operators.health import health
from mendwork.operators.paginate import follow
from mendwork.operators.repair import probe, repair
from mendwork.operators.schema import Selector, Strategy, default_strategy
from mendwork.operators.score import field_accuracy, with_hits
from mendwork.sources.layouts import pages
from mendwork.sources.pages import SNAPSHOT
from mendwork.sources.snapshots import read_snapshot_files, write_snapshot_files


class _Log(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []
        for name in ("starttag", "startendtag", "endtag", "data", "decl"):
            setattr(self, f"handle_{name}", lambda *a, name=name: self.events.append((name, *a)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_split_pages_give_the_events_of_the_parser():
    rng, split = random.Random(2), 0
    bits = ["<p>", "</p>", '<P class="a b">', '<a href="?a=1&amp;b">', "</a >", "<br/>", '<img src="a>b">', "x &lt;", "&copy", "<title>", "</title>", "<!doctype html>", ">", '<b\n id="q" k="">', "<i x=1>", "<u z>", "<!-- c -->", "<script>", "</script>", "<", "&", '<a href="', "</p x>", '<a B="1" b="2">', "</>"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
        own, by_parser = _Log(), _Log()
        markup.feed(own, text)
        by_parser.feed(text)
        if markup._OPEN_TAG.match(by_parser.rawdata):
            by_parser.rawdata = ""
        by_parser.close()
        assert own.events == by_parser.events, text
        split += markup._tokens(text) is not None
    assert split > 1000


def test_layout_pages_are_split_and_shuffled_as_products_alone(spark, products, site):
    assert all(markup._tokens(r.html) is not None for r in site.select("html").collect())
    plan = _plan(pages(products.selectExpr("pos % 2 AS site", "*"), ["site"]))
    assert len(re.findall(r"\bExchange ", plan)) == 1 and "Join" not in plan
    # tasks are not merged by the small size of the products
    assert "REPARTITION_BY_NUM" in plan


def test_records_of_pages_are_shuffled_once(spark, site):
    made = spark.createDataFrame(site.select("layout", "page_no", "url", "html").limit(2).collect(), "layout string, page_no int, url string, html string")
    plan = _plan(extract(made, default_strategy(), ["layout", "page_no"]).records)
    assert len(re.findall(r"\bExchange ", plan)) == 1 and "fingerprint" not in plan


def test_repair_scores_equal_candidates_once_and_broadcasts_nothing(spark, products, site):
    sick = site.where("page_no = 1 AND layout = 'v2_rename_class'").withColumns({"broken_fields": F.array(F.lit("price")), "strategy": F.lit(default_strategy().to_json())})
    made = probe(sick, ["layout"]).collect()[0].candidates
    for c in made:
        assert c.like == next(x.gen_ord for x in made if x.raws == c.raws)
    assert len({c.like for c in made}) < len(made) / 3
    repairs, ranked = repair(sick, ["layout"], golden=products)
    assert "Broadcast" not in _plan(repairs) + _plan(ranked)
    best, rows = repairs.collect()[0], sorted(ranked.collect(), key=lambda r: r["rank"])
    assert (best.value, best.total, best.generated) == (rows[0].value, rows[0].total, len(rows)) and rows[0].value == ".cost"
    assert [(r.total, r.gen_ord) for r in rows] == sorted(((r.total, r.gen_ord) for r in rows), key=lambda x: (-x[0], x[1]))


def test_texts_of_a_page_are_not_joined_to_its_nodes(spark):
    rows = [(1, "<div><p>Rated <b>4</b> of 5</p></div><div><i>no</i></div>"), (2, "<div>x<p>rated</p>y</div>"), (3, None)]
    table = nodes.nodes(spark.createDataFrame(rows, "page int, html string"), ["page"])
    got = nodes.raw_values(table, ["page"], Strategy("s", "div", {"around": Selector("text-anchor", "Rated"), "first": Selector("css", "b")}))
    plan = _plan(got)
    # one join, of roots with the children of what they found
    assert "Broadcast" not in plan and plan.count("Join") == 1
    assert sorted((r.page, r.pos, r.around, r.first) for r in got.collect()) == [(1, 0, "4 of 5", "4"), (1, 1, None, None), (2, 0, "xratedy", None)]


def test_snapshot_files_are_listed_by_tasks(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = [(f"http://h{k % 3}.example/{k}", "" if k == 5 else f"<p>{k}</p>", 200, "store", {}, float(k)) for k in range(12)]
    write_snapshot_files(spark.createDataFrame(rows, SNAPSHOT), root)
    read = read_snapshot_files(spark, root)
    assert "FileScan" not in _plan(read) and "Join" not in _plan(read)
    # an empty page is a page
    assert sorted((r.url, r.html, r.host) for r in read.collect()) == sorted((u, h, u[7:17]) for u, h, *_ in rows)
    assert read_snapshot_files(spark, str(tmp_path / "none")).collect() == []


def test_accuracy_in_the_pass_of_health(spark, products):
    rows = products.withColumns({"run": F.col("pos") % 3, "price": F.when(F.col("pos") % 4 > 0, F.col("price"))})
    golden = products.where("pos < 12").unionByName(products.where("pos = 5").withColumn("currency", F.lit("EUR")))
    golden = golden.where("pos % 3 < 2")
    want = {r.run: r.field_accuracy for r in field_accuracy(rows, golden, ["run"]).collect()}
    both, right = with_hits(rows, golden)
    got = health(both, ["run"], 7, more=[right])
    assert "Broadcast" not in _plan(got)
    assert {r.run: (r.records_received, r.field_accuracy) for r in got.collect()} == {0: (7, want[0]), 1: (7, want[1]), 2: (6, want.get(2))}
    assert want[0] < 1


def test_ways_are_found_without_broadcasts(spark):
    links = spark.createDataFrame([("a", "b"), ("b", None)], "url string, next_page_url string")
    assert "Broadcast" not in _plan(follow(links, []))
    assert sorted((r.url, r.pages, r.stopped) for r in follow(links, []).collect()) == [("a", ["a", "b"], "end"), ("b", ["b"], "end")]
