"""Queries over whole sites and fleets of scrapers, with their DuckDB SQL beside them.

Pages are generated from ``part``; what a query expects follows in SQL from
the same table by the rules by which the pages were made or damaged, never
from html. Queries over ``pages`` have SQL that reads the html by patterns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import shared_folder, stage
from ..operators import nodes
from ..operators.detect import detect_as_of
from ..operators.health import health
from ..operators.history import former_selectors, former_values
from ..operators.paginate import extract_all
from ..operators.repair import repair
from ..operators.rules import violation_rows
from ..operators.schema import Selector, Strategy, default_strategy
from ..operators.variant import typed
from ..sources.layouts import pages as layout_pages
from ..sources.log import StateLog
from ..sources.snapshots import read_snapshot_files, write_snapshot_files
from . import fleet
from .catalog import RECORDS, _golden, _products, _table, records
from .oracles import _FIELDS, _H, _P, _R, _V, _empty

# ---- pagination: sites of 250 products are 25 pages long

LONG = 250
_FIRST = "http://127.0.0.1:8765/list?page=1"


def _linked_pages(spark: SparkSession, sf_dir: str):
    """Every third site lacks its seventh page, every third leads from the fifth page back to the second."""
    made = layout_pages(_products(spark, sf_dir, LONG), ["site"], ["v1_healthy"]).drop("layout")
    made = made.withColumn("url", F.concat(F.lit("http://127.0.0.1:8765/list?page="), F.col("page_no").cast("string"))).where("NOT (site % 3 = 1 AND page_no = 7)")
    back = F.replace("html", F.lit('class="next" href="?page=6"'), F.lit('class="next" href="?page=2"'))
    made = made.withColumn("html", F.when((F.col("site") % 3 == 2) & (F.col("page_no") == 5), back).otherwise(F.col("html")))
    return extract_all(made, made.select("site", F.lit(_FIRST).alias("url")).distinct(), default_strategy(), ["site"])


def paginated_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked_pages(spark, sf_dir).records.select("site", F.col("place").cast("bigint").alias("place"), F.col("hop").cast("bigint").alias("hop"), "product_id", "product_name", "price")


def paginated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _linked_pages(spark, sf_dir).runs
    return runs.select("site", "n_pages", "stopped", "raw_len", F.regexp_extract(F.element_at("pages", -1), r"page=(\d+)", 1).cast("bigint").alias("last_page"), (F.length("fingerprint") > 0).alias("seen"))


_CHAIN = f"""p AS (SELECT p_partkey // {LONG} AS site, p_partkey % {LONG} AS pos, 'P' || p_partkey AS product_id, p_name || ' & ' || p_partkey AS product_name, round(p_partkey % 5000 + 1.25, 2)::DOUBLE AS price FROM part WHERE p_partkey >= 0),
n AS (SELECT site, max(pos) // 10 + 1 AS pages FROM p GROUP BY site),
c(site, hop, page, seen) AS (SELECT site, 0::BIGINT, 1::BIGINT, [1::BIGINT] FROM n UNION ALL
 SELECT x.site, x.hop + 1, x.nx, list_append(x.seen, x.nx) FROM (SELECT c.*, CASE WHEN site % 3 = 2 AND page = 5 THEN 2 ELSE page + 1 END AS nx FROM c) x JOIN n USING (site)
 WHERE x.page < n.pages AND NOT list_contains(x.seen, x.nx) AND NOT (x.site % 3 = 1 AND x.nx = 7) AND x.hop + 1 < 20)"""
_SQL_PAGES = f"WITH RECURSIVE {_CHAIN} SELECT p.site, row_number() OVER (PARTITION BY p.site ORDER BY hop, pos) - 1 AS place, hop, product_id, product_name, price FROM c JOIN p ON p.site = c.site AND p.pos // 10 + 1 = c.page"
_SQL_RUNS = f"""WITH RECURSIVE {_CHAIN}, k AS (SELECT site, max(hop) + 1 AS n_pages, arg_max(page, hop) AS last_page FROM c GROUP BY site)
SELECT site, n_pages, CASE WHEN site % 3 = 2 AND pages > 5 THEN 'repeat' WHEN site % 3 = 1 AND pages > 6 THEN 'missing' WHEN pages > 20 THEN 'limit' ELSE 'end' END AS stopped,
 (SELECT count(*) FROM c JOIN p ON p.site = c.site AND p.pos // 10 + 1 = c.page WHERE c.site = k.site) AS raw_len, last_page, true AS seen FROM k JOIN n USING (site)"""

# ---- the node table


def dom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.fingerprints(nodes.nodes(_table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    rows = nodes.matched(nodes.nodes(pages, ["page_id"]), ["page_id"], {"root": "html"})
    roots = rows.groupBy("page_id").agg(F.count_if("root").alias("n_roots"), F.count_if(F.col("tag") == "p").alias("n_paragraphs"), F.count_if(F.col("node") > 0).alias("_n"))
    return pages.select("page_id", F.length("html").cast("bigint").alias("raw_len")).join(roots.drop("_n"), "page_id")


def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendant, child, compound, list, attribute and nth-of-type selectors over all pages, one row per body."""
    css = lambda value, attr=None: Selector("css", value, attr)
    fields = {
        "first_link": css("nav li a", "href"), "second_link": css("nav > ul > li:nth-of-type(2) a[href]", "href"), "third": css("li:nth-of-type(3)"),
        "heading": css("h6, article > h1"), "notice": css("div.ad"), "none": css("article > li"), "kind": Selector("static", "page"),
    }
    return nodes.raw_values(nodes.nodes(_table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"], Strategy("page", "body", fields)).drop("pos")


def anchor_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the label Rated on the cards of a layout without classes for it."""
    pages = layout_pages(_products(spark, sf_dir), ["site"], ["v6_label_change"])
    fields = {"product_id": Selector("attr-on-self", "data-product-id"), "around": Selector("text-anchor", "Rated")}
    got = nodes.raw_values(nodes.nodes(pages, ["site", "page_no"]), ["site", "page_no"], Strategy("cards", "article.product-card", fields))
    return got.select("site", F.col("page_no").cast("bigint").alias("page_no"), F.col("pos").cast("bigint").alias("pos"), "product_id", "around")


def page_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.vocabulary(nodes.nodes(_table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])
    return found.select("page_id", F.array_join("classes", ",").alias("classes"), F.array_join("data_attrs", ",").alias("data_attrs"))


_BARE = "regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '<\\1>', 'g')"
_TAGS = rf"""t AS (SELECT page_id, unnest(l) AS tag, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all({_BARE}, '<[A-Za-z][a-z0-9]*(?: [^>]*)?>') AS l FROM pages)),
 e AS (SELECT page_id, i, lower(regexp_extract(tag, '<([A-Za-z0-9]+)', 1)) AS tag, regexp_extract(tag, 'class="([^"]*)"', 1) AS cls, tag AS whole FROM t)"""
_SQL_PRINTS = f"""WITH {_TAGS}, k AS (SELECT page_id, tag || CASE WHEN cls <> '' THEN '.' || cls ELSE '' END AS k, count(*) AS n, min(i) AS f FROM e WHERE i < 2000 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f) AS r FROM k)
SELECT page_id, coalesce(string_agg(k || '=' || n, ',' ORDER BY r) FILTER (WHERE r <= 20), '') AS fingerprint FROM pages LEFT JOIN r USING (page_id) GROUP BY page_id"""
_SQL_FACTS = f"WITH {_TAGS} SELECT page_id, any_value(length(html)) AS raw_len, count(*) FILTER (WHERE e.tag = 'html') AS n_roots, count(*) FILTER (WHERE e.tag = 'p') AS n_paragraphs FROM pages LEFT JOIN e USING (page_id) GROUP BY page_id"
# the pages have the references &amp; &lt; and &gt;, and stray signs beside them
_SQL_SELECT = r"""WITH l AS (SELECT page_id, replace(replace(replace(html, '&lt;', '〈'), '&gt;', '〉'), '&amp;', '&') AS html, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS t FROM pages)
SELECT page_id, h[1] AS first_link, h[2] AS second_link, trim(t[3]) AS third, translate(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '〈〉', '<>') AS heading, translate(trim(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)), '〈〉', '<>') AS notice, CAST(NULL AS VARCHAR) AS "none", 'page' AS kind FROM l"""
_SQL_ANCHORS = f"""WITH {_P} SELECT site, substr(product_id, 2)::BIGINT % 20 // 10 + 1 AS page_no, row_number() OVER (PARTITION BY site, substr(product_id, 2)::BIGINT % 20 // 10 ORDER BY substr(product_id, 2)::BIGINT) - 1 AS pos, product_id,
 trim(replace(product_name || 'Buy for ₹' || format('{{:,.2f}}', price) || ' ' || currency || 'Rated ' || format('{{:.1f}}', rating) || ' /5 · ' || format('{{:,}}', review_count) || ' ratings' || 'Availability: ' || availability, 'Rated', ''), ' :·-') AS around FROM p"""
_SQL_WORDS = f"""WITH {_TAGS} SELECT page_id, coalesce(string_agg(DISTINCT lower(cls), ',' ORDER BY lower(cls)) FILTER (WHERE cls <> ''), '') AS classes, '' AS data_attrs FROM pages LEFT JOIN e USING (page_id) GROUP BY page_id"""

# ---- detection against the last good run

#: records of twelve runs a brand, of which every third is clean; both engines read this
TURNS = f"""SELECT brand, turn, brand || '/' || CAST(turn AS STRING) AS run, pos, product_id, CASE WHEN clean THEN 'Item ' || CAST(pos AS STRING) ELSE product_name END AS product_name,
 CASE WHEN clean THEN CAST(10 + pos % 7 AS DOUBLE) ELSE price END AS price, CASE WHEN clean THEN 'USD' ELSE currency END AS currency, CASE WHEN clean THEN CAST(3 AS DOUBLE) ELSE rating END AS rating,
 CASE WHEN clean THEN CAST(5 AS BIGINT) ELSE review_count END AS review_count, CASE WHEN clean THEN 'In Stock' ELSE availability END AS availability,
 CASE WHEN clean THEN 'http://shop.example/p/' || CAST(pos AS STRING) ELSE product_url END AS product_url, CASE WHEN clean THEN 'http://shop.example/i/' || CAST(pos AS STRING) ELSE image_url END AS image_url,
 loose_price AND NOT clean AS loose_price FROM (SELECT *, run AS brand, pos % 12 AS turn, pos % 12 % 3 = 1 OR pos % 12 = 5 AND run LIKE '%2' AS clean FROM ({RECORDS}))"""
_LISTS = ("fields_broken_now", "fields_broken_baseline", "newly_broken_fields", "recovered_fields")


def detection_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's detection report, all members of its evidence too, against the last healthy run of the brand."""
    rows = spark.sql(TURNS, part=_table(spark, sf_dir, "part"))
    empty = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("loose", F.when(F.col("loose_price"), F.create_map(F.lit("price"), F.lit("cheap"))).otherwise(empty)).drop("loose_price")
    found = detect_as_of(health(rows, ["brand", "turn"]), ["brand"], "turn", span=4)
    parts = lambda c: F.round(F.col(c) * 10_000).cast("bigint")
    ev = lambda c: F.col(f"evidence.{c}")
    return found.select(
        "brand", F.col("turn").cast("bigint").alias("turn"), "detected", "severity", parts("confidence").alias("confidence"), F.size("triggering_rules").cast("bigint").alias("n_rules"),
        *[parts(f"evidence.{c}").alias(c) for c in ("baseline_health", "current_health", "health_delta")], *[ev(c).cast("bigint").alias(c) for c in ("baseline_record_count", "current_record_count", "record_count_delta")],
        ev("fingerprint_changed").alias("fingerprint_changed"), *[F.array_join(ev(c), ",").alias(c) for c in _LISTS],
        *[F.round(F.element_at(ev("null_rate_deltas"), f) * 10_000).cast("bigint").alias(f"delta_{f}") for f in _FIELDS],
    )


_H1 = _H.replace("greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(count(*) - 100)::DOUBLE / 100)", "1.0::DOUBLE")
# completeness as a quotient of counts, as it is defined; the difference from 1 is another double now and then
_GAPS = " + ".join(map(_empty, _FIELDS))
_H1 = _H1.replace(f"1.0::DOUBLE - sum({_GAPS})::DOUBLE / (count(*) * 8) AS c", f"(count(*) * 8 - sum({_GAPS}))::DOUBLE / (count(*) * 8) AS c")
_SORTED = sorted(_FIELDS)
_list = lambda test: "concat_ws(',', " + ", ".join(f"CASE WHEN {test(f)} THEN '{f}' END" for f in _SORTED) + ")"
_SQL_AS_OF = f"""WITH r AS ({TURNS.format(part='part')}), {_V}, {_H1},
g AS (SELECT r.brand, r.turn, any_value(h.n) AS n, any_value(round_even(0.30::DOUBLE * c + 0.30::DOUBLE * vd + 0.20::DOUBLE * s + 0.20::DOUBLE * rc, 4)) AS score, any_value(0.30::DOUBLE * c + 0.30::DOUBLE * vd + 0.20::DOUBLE * s + 0.20::DOUBLE * rc) AS raw,
 {', '.join(f"round_even(avg({_empty(f)}), 4) AS {f}" for f in _FIELDS)}, sum(CAST(loose_price AS INT)) AS drift, CAST(count(*) >= 2 AND count(price) >= 3 AND min(price) = max(price) AS INT)
 + CAST(count(*) >= 2 AND count(nullif(product_url, '')) >= 3 AND min(nullif(product_url, '')) = max(nullif(product_url, '')) AS INT) + CAST(count(*) >= 2 AND count(nullif(product_name, '')) >= 3 AND min(nullif(product_name, '')) = max(nullif(product_name, '')) AS INT) AS same
 FROM r JOIN h ON h.run = r.run GROUP BY r.brand, r.turn),
t AS (SELECT *, CAST(CAST(raw AS VARCHAR) AS DECIMAL(38, 20)) * 10000 AS x4 FROM g), -- ties are those of the decimal text
s AS (SELECT * EXCLUDE (score, x4), (floor(x4) + CASE WHEN x4 - floor(x4) > 0.5 OR x4 - floor(x4) = 0.5 AND floor(x4) % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE / 10000 AS score, CASE WHEN raw >= 0.9 THEN 'healthy' WHEN raw >= 0.7 THEN 'warning' ELSE 'repair_required' END AS status FROM t),
o AS (SELECT *, last_value(CASE WHEN status = 'healthy' THEN turn END IGNORE NULLS) OVER (PARTITION BY brand ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bt FROM s),
d AS (SELECT o.*, b.score AS b_score, b.n AS b_n, {', '.join(f'b.{f} AS b_{f}, round_even(o.{f} - coalesce(b.{f}, 0), 4) AS d_{f}' for f in _FIELDS)}, CASE WHEN b.turn IS NULL THEN 0 ELSE o.score - b.score END AS delta FROM o LEFT JOIN s b ON b.brand = o.brand AND b.turn = o.bt),
x AS (SELECT *, CAST(status = 'repair_required' AS INT) + CAST(bt IS NOT NULL AND -delta >= 0.20 AS INT) + CAST(bt IS NOT NULL AND greatest({', '.join(f'd_{f}' for f in _FIELDS)}) >= 0.40 AS INT) AS crit,
 CAST(status = 'warning' AS INT) + CAST(bt IS NOT NULL AND -delta >= 0.05 AS INT) + CAST(drift > 0 AS INT) + same AS warn FROM d)
SELECT brand, CAST(turn AS BIGINT) AS turn, crit + warn > 0 AS detected, CASE WHEN crit > 0 THEN 'critical' WHEN warn > 0 THEN 'warning' ELSE 'none' END AS severity,
 CAST(round(10000 * round_even(CASE WHEN crit > 0 THEN least(1.0, 0.6::DOUBLE + 0.1::DOUBLE * crit + greatest(0.0, 0.9::DOUBLE - score)) WHEN warn > 0 THEN least(1.0, 0.4::DOUBLE + 0.1::DOUBLE * warn) WHEN status = 'healthy' THEN 1.0 ELSE 0.8 END, 4)) AS BIGINT) AS confidence,
 CAST(CASE WHEN crit > 0 THEN crit ELSE warn END AS BIGINT) AS n_rules, CAST(round(b_score * 10000) AS BIGINT) AS baseline_health, CAST(round(score * 10000) AS BIGINT) AS current_health, CAST(round(delta * 10000) AS BIGINT) AS health_delta,
 b_n AS baseline_record_count, n AS current_record_count, CASE WHEN bt IS NULL THEN 0 ELSE n - b_n END AS record_count_delta, false AS fingerprint_changed,
 {_list(lambda f: f'{f} >= 0.5')} AS fields_broken_now, {_list(lambda f: f'b_{f} >= 0.5')} AS fields_broken_baseline, {_list(lambda f: f'{f} >= 0.5 AND coalesce(b_{f}, 0) < 0.5')} AS newly_broken_fields, {_list(lambda f: f'b_{f} >= 0.5 AND {f} < 0.5')} AS recovered_fields,
 {', '.join(f'CAST(round(d_{f} * 10000) AS BIGINT) AS delta_{f}' for f in _FIELDS)} FROM x"""

#: records of two halves of each brand, of which the second lost the prices of some brands, as ``detect_severity`` makes them
_HALVES = f"""SELECT run AS brand, turn, run || '/' || CAST(turn AS STRING) AS run, pos, product_id, product_name, CASE WHEN NOT cut THEN price END AS price, currency, rating, review_count, availability, product_url, image_url, loose_price AND NOT cut AS loose_price
 FROM (SELECT *, pos % 2 AS turn, pos % 2 = 1 AND run LIKE '%3' AS cut FROM ({RECORDS.format(part='part')}))"""
_LAST_GOOD = "last_value(CASE WHEN status = 'healthy' THEN turn END IGNORE NULLS) OVER (PARTITION BY brand ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_FIRST_HALF = "CASE WHEN turn = 1 THEN max(CASE WHEN turn = 0 THEN 0 END) OVER (PARTITION BY brand) END"
_SQL_SEVERITY = "SELECT brand AS run, severity, detected FROM (" + _SQL_AS_OF.replace(TURNS.format(part="part"), _HALVES).replace(_LAST_GOOD, _FIRST_HALF) + ") WHERE turn = 1"

# ---- all scrapers at once

#: layouts of the fleet, the last one without a record root
FLEET = ("v1_healthy", "v2_rename_class", "v3_dataattr", "v9_combined", "v10_partial", "v4_change_nesting")


def _fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, scrapers, golden): a scraper per site and layout; sites of remainder 3 by 5 have golden records of other prices and stocks."""
    products = _products(spark, sf_dir)
    pages = layout_pages(products, ["site"], list(FLEET)).where("page_no = 1")
    number = F.coalesce(*[F.when(F.col("layout") == name, F.lit(n)) for n, name in enumerate(FLEET)])
    html = F.when(number == len(FLEET) - 1, F.replace("html", F.lit("<article class"), F.lit("<section class"))).otherwise(F.col("html"))
    pages = pages.select((F.col("site") * 16 + number).alias("scraper_id"), "site", F.concat("url", F.lit("?site="), F.col("site").cast("string")).alias("url"), html.alias("html"))
    scrapers = pages.select("scraper_id", F.lit(1).alias("current_version"), (F.col("site") % 3 + 1).cast("int").alias("max_version"), F.lit(default_strategy().to_json()).alias("strategy"), F.lit(10).alias("expected"))
    other = F.col("site") % 5 == 3
    golden = _golden(spark, sf_dir).withColumns({"price": F.when(other, F.col("price") + 900_000.5).otherwise(F.col("price")), "availability": F.when(other, "Elsewhere").otherwise(F.col("availability"))})
    return pages.drop("site"), scrapers, golden.join(pages.select("site", "scraper_id"), "site").drop("site")


def fleet_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, scrapers, golden = _fleet(spark, sf_dir)
    made = fleet.run_all(pages, scrapers, golden).decisions
    parts = lambda c: F.round(F.col(c) * 10_000).cast("bigint").alias(c)
    return made.select("scraper_id", "old_version", "new_version", "action", "candidate_count", F.col("failure_reason").isNotNull().alias("failed"), F.col("strategy").isNotNull().alias("proposed"), parts("confidence"), parts("pre_health"), parts("post_health"))


_SQL_FLEET = f"""WITH l AS (SELECT unnest([{', '.join(repr(x) for x in FLEET)}]) AS layout, unnest(range({len(FLEET)})) AS k),
p AS (SELECT p_partkey // 20 AS site, count(*) AS n FROM part WHERE p_partkey >= 0 AND p_partkey % 20 < 10 GROUP BY ALL),
x AS (SELECT site * 16 + k AS scraper_id, site, layout, n, site % 5 = 3 AS other, 0.2::DOUBLE * n / 10 AS rc, CASE layout WHEN 'v3_dataattr' THEN 6 WHEN 'v1_healthy' THEN 0 WHEN 'v4_change_nesting' THEN -1 ELSE 1 END AS lost FROM p, l),
y AS (SELECT *, CASE WHEN lost < 0 THEN 0.2::DOUBLE WHEN lost = 0 THEN 0.8::DOUBLE + rc ELSE 0.3::DOUBLE * (8 - lost) / 8 + 0.2::DOUBLE + rc END AS pre, 0.8::DOUBLE + rc AS post FROM x)
SELECT scraper_id, 1 AS old_version, CASE WHEN lost <= 0 AND pre >= 0.9 THEN 1 WHEN lost > 0 AND NOT other AND post >= 0.9 THEN CAST(site % 3 + 2 AS INT) END AS new_version,
 CASE WHEN pre >= 0.9 THEN 'no_change' WHEN lost <= 0 THEN 'reject' WHEN NOT other AND post >= 0.9 THEN 'promote' ELSE 'shadow' END AS action, greatest(lost, 0) * 5 AS candidate_count, pre < 0.9 AS failed, lost > 0 AS proposed,
 CAST(CASE WHEN pre >= 0.9 THEN 10000 WHEN lost <= 0 THEN 0 WHEN NOT other THEN 9250 WHEN lost = 6 THEN 8750 ELSE 7750 END AS BIGINT) AS confidence,
 CAST(round(pre * 10000) AS BIGINT) AS pre_health, CAST(round(CASE WHEN pre >= 0.9 THEN pre WHEN lost > 0 THEN post END * 10000) AS BIGINT) AS post_health FROM y"""

# ---- repair from history


def historical_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that went back to an element that no vocabulary has, but their first version did; prices of every other product were seen before."""
    products = _products(spark, sf_dir)
    pages = layout_pages(products, ["site"], ["v9_combined"]).where("page_no = 1")
    html = F.regexp_replace("html", r'<span class="cost current">([^<]*)</span>', r'<em class="zz9">$1</em>')
    sick = pages.select(F.col("site").alias("scraper_id"), "url", html.alias("html"), F.array(F.lit("price")).alias("broken_fields"), F.lit(default_strategy().to_json()).alias("strategy"))
    own = default_strategy()
    first = Strategy("first", own.record_selector, dict(own.fields) | {"price": Selector("css", "em.zz9", None, "price")})
    late = Strategy("late", own.record_selector, dict(own.fields) | {"price": Selector("css", "em", None, "price")})
    texts = F.explode(F.array(*[F.struct(F.lit(n).alias("version"), F.lit(n * 10).alias("seq"), F.lit(s.to_json()).alias("strategy")) for n, s in ((1, first), (2, own), (3, late))]))
    versions = sick.select("scraper_id", texts.alias("v")).select("scraper_id", "v.*")
    # the run came before the third version
    past = former_selectors(versions, sick.select("scraper_id", F.lit(25).alias("seq")))
    values = former_values(products.where("pos % 2 = 0").withColumnRenamed("site", "scraper_id"))
    golden = _golden(spark, sf_dir).withColumnRenamed("site", "scraper_id")
    found = repair(sick, ["scraper_id"], golden=golden, historical=past, historical_values=values, site=["scraper_id"])[0]
    return found.select("scraper_id", "field", "value", "source", "similarity", "historical_consistency", "total", "action", F.col("generated").cast("bigint").alias("generated"))


_SQL_HISTORY = """WITH p AS (SELECT p_partkey // 20 AS scraper_id, avg(CAST(p_partkey % 2 = 0 AS INT)) AS c FROM part WHERE p_partkey >= 0 AND p_partkey % 20 < 10 GROUP BY ALL)
SELECT scraper_id, 'price' AS field, 'em.zz9' AS value, 'historical' AS source, 1.0::DOUBLE AS similarity, round_even(c, 4) AS historical_consistency, round_even(0.85::DOUBLE + 0.15::DOUBLE * c, 4) AS total,
 CASE WHEN round_even(0.85::DOUBLE + 0.15::DOUBLE * c, 4) >= 0.9 THEN 'promote' ELSE 'shadow' END AS action, CAST(34 AS BIGINT) AS generated FROM p"""

# ---- state by log and snapshots


def _logged(spark: SparkSession, sf_dir: str) -> StateLog:
    """All events as the log of scrapers, in four batches: signups and purchases are versions, errors roll back to version 1, others deploy the newest."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("scraper_id"), F.col("event_id").alias("name"), "event_type")
    kind = F.when(F.col("event_type") == "error", "rollback").otherwise("deploy")
    both = F.when(F.col("event_type").isin("signup", "purchase"), F.array(F.lit("version"), F.lit("deploy"))).otherwise(F.array(kind))
    events = rows.select("scraper_id", F.col("name").alias("_event"), F.col("name").cast("string").alias("name"), F.posexplode(both).alias("_step", "kind")).withColumn("version", F.when(F.col("kind") == "rollback", 1))
    log = StateLog(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", fan=3)
    bounds = events.agg(F.min("_event").alias("a"), F.max("_event").alias("b"))
    placed = events.join(F.broadcast(bounds)).withColumn("_batch", F.floor((F.col("_event") - F.col("a")) * 4 / (F.col("b") - F.col("a") + 1)))
    for n in range(4):
        log.append(f"events-{n}", placed.where(F.col("_batch") == n), ["_event", "_step"])
    return log


def _kept(log: StateLog, df: DataFrame) -> DataFrame:
    """The result, once the log's files are gone."""
    out = stage(df)
    log._drop(log.root)
    return out


def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _logged(spark, sf_dir)
    return _kept(log, log.events("version").select(F.col("scraper_id").alias("id"), F.col("name").cast("bigint").alias("seq"), F.col("version").cast("bigint").alias("version")))


def rollback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _logged(spark, sf_dir)
    return _kept(log, log.state().select(F.col("scraper_id").alias("id"), F.col("max_version").cast("bigint").alias("versions"), F.coalesce("current_version", F.lit(0)).cast("bigint").alias("current_version")))


# ---- loosely typed records and snapshot files


def variant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of records that came as JSON; some values have a type that their field does not allow."""
    rows, pos = records(spark, sf_dir), F.col("pos")
    odd = {
        "price": F.when(F.map_contains_key("loose", "price"), F.element_at("loose", "price").cast("variant")),
        "review_count": F.when(pos % 47 == 0, (pos + F.lit(0.5).cast("double")).cast("variant")),
        "product_name": F.when(pos % 53 == 0, pos.cast("variant")),
        "currency": F.when(pos % 59 == 0, F.lit(True).cast("variant")),
        "image_url": F.when(pos % 61 == 0, F.to_variant_object(F.struct(F.col("image_url").alias("src")))),
    }
    members = [F.coalesce(*([odd[f]] if f in odd else []), F.col(f).cast("variant")).alias(f) for f in ("product_id", *_FIELDS)]
    text = F.to_json(F.to_variant_object(F.struct(*members)))
    return violation_rows(typed(rows.select("run", "pos", F.parse_json(text).alias("record"))), ["run"]).select("run", "pos", "field", "code")


_ODD = (("review_count", 47), ("product_name", 53), ("currency", 59), ("image_url", 61))
_SQL_VARIANT = f"""WITH {_R}, {_V} SELECT run, pos, field, code FROM v WHERE {" AND ".join(f"NOT (field = '{f}' AND pos % {n} = 0)" for f, n in _ODD)}
{" ".join(f"UNION ALL SELECT run, pos, '{f}', 'wrong_type' FROM r WHERE pos % {n} = 0" for f, n in _ODD)} UNION ALL SELECT run, pos, 'currency', 'not_iso4217' FROM r WHERE pos % 59 = 0"""


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a snapshot file with its metadata, and read back."""
    root = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    meta = F.create_map(F.lit("page"), F.col("page_id").cast("string"))
    pages = _table(spark, sf_dir, "pages").select("url", "html", F.lit(200).alias("status_code"), F.lit("store").alias("provider"), meta.alias("provider_meta"), F.col("page_id").cast("double").alias("fetched_at"))
    write_snapshot_files(pages, root)
    read = read_snapshot_files(spark, root)
    return read.select(F.element_at("provider_meta", "page").cast("bigint").alias("page_id"), "host", "content_sha", F.col("bytes").cast("bigint").alias("bytes"), F.sha2("html", 256).alias("html_sha256"))


_SQL_FILES = r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '[^A-Za-z0-9._-]', '_', 'g'), ''), 'unknown') AS host,
 substr(sha256(html), 1, 16) AS content_sha, length(html) AS bytes, sha256(html) AS html_sha256 FROM pages WHERE html IS NOT NULL"""

QUERIES = {q.__name__: q for q in (
    paginated_extract, paginated_runs, dom_fingerprints, page_facts, page_select, anchor_values, page_vocabulary, detection_as_of, fleet_decisions, historical_repairs, version_numbers, rollback_state,
    variant_violations, snapshot_files,
)}

ORACLES = {
    "paginated_extract": _SQL_PAGES, "paginated_runs": _SQL_RUNS, "dom_fingerprints": _SQL_PRINTS, "page_facts": _SQL_FACTS, "page_select": _SQL_SELECT, "anchor_values": _SQL_ANCHORS,
    "page_vocabulary": _SQL_WORDS, "detection_as_of": _SQL_AS_OF, "detect_severity": _SQL_SEVERITY, "fleet_decisions": _SQL_FLEET, "historical_repairs": _SQL_HISTORY,
    "variant_violations": _SQL_VARIANT, "snapshot_files": _SQL_FILES,
}
