import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mendwork.operators import serial
from mendwork.operators.detect import detect
from mendwork.operators.health import health
from mendwork.operators.rules import violation_rows
from mendwork.operators.schema import FIELDS, ID
from mendwork.operators.variant import typed, untyped
from mendwork.sources.pages import ProxySource
from mendwork.sources.snapshots import read_snapshot_files, write_snapshot_files


def _records(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "pos int, t string")
    return typed(rows.select("pos", F.parse_json("t").alias("record")))


def test_types_of_variant_members(spark):
    got = _records(spark, [
        '{"product_id": 7, "price": 8999.0, "rating": 4, "review_count": 1284, "currency": "INR", "other": 1}',
        '{"price": "12", "rating": null, "review_count": 3.0, "product_name": 5, "currency": true, "image_url": {"a": 1}}',
        '{"price": true, "review_count": "", "rating": 1e3, "product_name": [1]}',
        '[1, 2]', '"text"', "null", None,
    ]).orderBy("pos").collect()
    assert (got[0].product_id, got[0].price, got[0].rating, got[0].review_count, got[0].currency, got[0].loose) == ("7", 8999.0, 4.0, 1284, "INR", {})
    assert got[1].loose == {"price": "12", "review_count": "3", "product_name": "5", "currency": "true", "image_url": '{"a":1}'}
    assert all(got[1][f] is None for f in FIELDS)
    assert (got[2].price, got[2].rating, got[2].loose) == (1.0, 1000.0, {"review_count": "", "product_name": "[1]"})
    assert all(r[f] is None for r in got[3:] for f in (ID, *FIELDS)) and not any(r.loose for r in got[3:])


def test_variant_rows_break_the_same_rules(spark, products):
    odd = products.withColumns({
        "loose": F.when(F.col("pos") % 4 == 1, F.create_map(F.lit("price"), F.lit("cheap"))).when(F.col("pos") % 4 == 2, F.create_map(F.lit("currency"), F.lit("12"))).otherwise(F.col("loose")),
        "price": F.when(F.col("pos") % 4 == 1, None).otherwise(F.col("price")), "currency": F.when(F.col("pos") % 4 == 2, None).otherwise(F.col("currency")),
    }).withColumn("run", F.lit(1))
    back = typed(untyped(odd))
    assert sorted(map(str, violation_rows(back, ["run"]).collect())) == sorted(map(str, violation_rows(odd, ["run"]).collect()))
    through = typed(untyped(odd).select("run", "pos", F.parse_json(F.to_json("record")).alias("record")))
    columns = ["pos", ID, *FIELDS, "loose"]
    assert sorted(map(str, through.select(columns).collect())) == sorted(map(str, odd.select(columns).collect()))
    assert typed(untyped(odd).withColumn("price", F.lit("clash"))).schema["price"].dataType.simpleString() == "double"
    assert typed(untyped(odd).limit(0)).count() == 0


def test_reports_round_trip(spark, products):
    report = health(products.withColumn("run", F.lit("a")), ["run"], 25)
    text = serial.to_text(report, ["run"])
    read = serial.from_text(text, serial.HEALTH_REPORT)
    assert read.columns == report.columns and [f.dataType.simpleString() for f in read.schema] == [f.dataType.simpleString() for f in report.schema]
    assert read.collect() == report.collect()
    found = detect(report.withColumn("fingerprint", F.lit("x")), None, ["run"])
    again = serial.from_text(serial.to_text(found, ["run"]), serial.DETECTION_REPORT)
    assert again.columns == found.columns and again.schema["evidence"].dataType.names == found.schema["evidence"].dataType.names
    assert again.collect() == found.collect()
    # a member more, a member less, no text
    rows = spark.createDataFrame([(1, '{"status": "healthy", "extra": 1}'), (2, None)], "run int, report string")
    got = serial.from_text(rows, serial.HEALTH_REPORT).orderBy("run").collect()
    assert (got[0].status, got[0].health_score, got[1].status) == ("healthy", None, None)


def test_json_lines(spark, products, tmp_path):
    report = health(products.withColumn("run", F.lit("a")), ["run"])
    serial.write_json(report, str(tmp_path / "r"))
    assert spark.read.schema("run string, " + serial.HEALTH_REPORT).json(str(tmp_path / "r")).collect() == report.collect()


def _snapshots(spark, rows):
    return spark.createDataFrame(rows, "url string, html string, status_code int, provider string, provider_meta map<string,string>, fetched_at double")


def test_snapshot_files(spark, tmp_path):
    root = str(tmp_path / "shots")
    rows = [(f"http://h{i % 3}.example:80/p?{i}", f"<p>ü {i}</p>\n", 200, "store", {"page": str(i)}, 1000.5 + i) for i in range(12)] + [("no address", "<p>x</p>", 200, "store", None, 5.0), ("http://h0.example/gone", None, 404, "store", None, 7.0)]
    pages = _snapshots(spark, rows)
    write_snapshot_files(pages, root)
    files = sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and "_commits" not in str(p))
    assert len(files) == 26 and all(f.endswith((".html", ".json")) for f in files) and {f.split("/")[0] for f in files} == {"h0.example_80", "h1.example_80", "h2.example_80", "unknown"}
    got = {r.url: (r.html, r.status_code, r.provider_meta, r.fetched_at, r.bytes) for r in read_snapshot_files(spark, root).collect()}
    assert got == {u: (h, s, m or {}, t, len(h)) for u, h, s, _, m, t in rows if h}
    # a repeated write changes nothing but the list of commits
    write_snapshot_files(pages, root)
    assert sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and "_commits" not in str(p)) == files
    assert len(list(Path(root, "_commits").glob("*.json"))) == 2 and not any(Path(root, "_staged").iterdir())
    # a lost metadata file and an altered page are errors
    page = next(Path(root, "unknown").glob("*.html"))
    page.write_text("altered")
    with pytest.raises(Exception, match="hash of its name"):
        read_snapshot_files(spark, root).collect()
    page.with_suffix(".json").unlink()
    with pytest.raises(Exception, match="no metadata"):
        read_snapshot_files(spark, root).collect()


def test_failed_write_leaves_whole_files_and_no_commit(spark, tmp_path):
    root = str(tmp_path / "shots")
    good = [(f"http://h.example/{i}", f"<p>{i}</p>", 200, "store", None, float(i)) for i in range(5)]
    broken = _snapshots(spark, good).withColumn("html", F.when(F.col("url").endswith("4"), F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        write_snapshot_files(broken, root)
    assert not Path(root, "_commits").exists()
    assert not Path(root, "_staged").exists() or not any(Path(root, "_staged").iterdir())
    for page in Path(root).rglob("*.html"):
        assert page.with_suffix(".json").exists() and page.read_text().startswith("<p>")


def test_proxy_keeps_its_distance_from_each_host(spark):
    seen, lock = [], threading.Lock()

    class Proxy(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                seen.append((self.path.split("/")[2], time.time(), self.headers["User-Agent"]))
            self.send_response(404 if "gone" in self.path else 200)
            self.end_headers()
            self.wfile.write(f"<p>{self.path}</p>".encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Proxy)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        source = ProxySource(f"http://127.0.0.1:{server.server_port}", delay=0.3)
        urls = spark.createDataFrame([(f"http://{h}.example/{i}",) for h in "ab" for i in range(4)], "url string").repartition(8)
        got = source.fetch(urls).collect()
        assert {r.url: r.html for r in got} == {r.url: f"<p>{r.url}</p>" for r in urls.collect()} and {r.status_code for r in got} == {200}
        for host in ("a.example", "b.example"):
            times = sorted(t for h, t, _ in seen if h == host)
            assert len(times) == 4 and min(b - a for a, b in zip(times, times[1:])) >= 0.28
        assert all(agent.startswith("Mozilla/5.0") for _, _, agent in seen)
        with pytest.raises(Exception, match="404"):
            source.fetch(spark.createDataFrame([("http://a.example/gone",)], "url string")).collect()
    finally:
        server.shutdown()


def test_session_defaults(spark, site, products, tmp_path):
    from mendwork.plans.session import Session
    from mendwork.sources.pages import PageStore

    session = Session(spark, str(tmp_path / "state"), PageStore(site.where("layout IN ('v1_healthy', 'v2_class')") if site.where("layout = 'v2_class'").count() else site))
    assert session.status()["scrapers"] == 0
    scraper = session.register("shop", "http://127.0.0.1:8765/list?page=1")
    assert session.status() == {"status": "ok", "provider": "store", "proxy_configured": False, "scrapers": 1}
    report, decision = session.run_now(scraper, golden=products)
    assert (report.records_expected, report.records_received, decision.action) == (20, 10, "no_change")
    assert session.run_now(scraper, expected=10, layout="v1_healthy")[1].action == "no_change"
    assert "v1_healthy" in session.layouts() and session.layouts() == sorted(session.layouts())
    assert session.version(scraper, 1) == session.active_strategy(scraper)
    with pytest.raises(LookupError):
        session.version(scraper, 9)
