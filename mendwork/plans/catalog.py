"""Registered queries of the extraction engine over the driver tables.

Inputs are derived from the tables by SQL that both engines read alike:
``RECORDS`` makes product records with planted defects of ``part``, ``TEXTS``
raw field texts. Every query works on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import urls as U
from ..functions.stage import large
from ..operators import benchmark
from ..operators.dedupe import dedupe
from ..operators.detect import accuracy, detect
from ..operators.extract import extract
from ..operators.health import broken_fields, health
from ..operators.repair import repair
from ..operators.rules import validate, violation_rows
from ..operators.schema import FIELDS, Selector, Strategy, default_strategy
from ..operators.score import field_accuracy, field_scores
from ..sources.layouts import LAYOUTS, pages as layout_pages
from ..sources.pages import snapshot_keys
from ..sources.store import current, latest

RECORDS = """
SELECT p_brand AS run, CAST(p_partkey AS INT) AS pos, 'P' || CAST(p_partkey AS STRING) AS product_id,
 CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN 'N/A' WHEN p_partkey % 17 = 0 THEN ' Buy Now'
  WHEN p_partkey % 19 = 0 THEN '<b>' || p_name || '</b>' WHEN p_partkey % 23 = 0 THEN 'x' ELSE p_name END AS product_name,
 CAST(CASE WHEN p_partkey % 7 = 0 OR p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 0.0 WHEN p_partkey % 31 = 0 THEN -5.0
  WHEN p_partkey % 37 = 0 THEN 20000000.0 WHEN p_partkey % 43 = 0 THEN 0.01 ELSE p_retailprice END AS DOUBLE) AS price,
 CASE WHEN p_partkey % 9 = 0 THEN 'usd' WHEN p_partkey % 10 = 0 THEN NULL ELSE 'USD' END AS currency,
 CAST(CASE WHEN p_partkey % 12 = 0 THEN 7.5 WHEN p_partkey % 14 = 0 THEN NULL ELSE p_size % 5 END AS DOUBLE) AS rating,
 CAST(CASE WHEN p_partkey % 15 = 0 THEN -1 WHEN p_partkey % 16 = 0 THEN NULL ELSE p_size * 10 END AS BIGINT) AS review_count,
 CASE WHEN p_partkey % 5 = 0 THEN 'Out of Stock' ELSE 'In Stock' END AS availability,
 CASE WHEN p_partkey % 18 = 0 THEN '/p/' || CAST(p_partkey AS STRING) WHEN p_partkey % 20 = 0 THEN NULL ELSE 'http://shop.example/p/' || CAST(p_partkey AS STRING) END AS product_url,
 CASE WHEN p_partkey % 21 = 0 THEN '' ELSE 'http://shop.example/i/' || CAST(p_partkey AS STRING) END AS image_url,
 p_partkey % 41 = 0 AS loose_price
FROM {part}"""

TEXTS = """
SELECT p_partkey, p_type, CASE p_partkey % 10 WHEN 0 THEN '$1,' || CAST(100 + p_size AS STRING) || '.50' WHEN 1 THEN '1.' || CAST(100 + p_size AS STRING) || ',25 EUR'
 WHEN 2 THEN '₹' || CAST(p_size * 37 AS STRING) WHEN 3 THEN 'Buy for  £ ' || CAST(p_size AS STRING) || ' now' WHEN 4 THEN '-' || CAST(p_size AS STRING)
 WHEN 5 THEN CAST(p_size AS STRING) || ',' || CAST(10 + p_size AS STRING) || ' usd' WHEN 6 THEN 'Free!' WHEN 7 THEN ' RS. ' || CAST(p_size * 1000 AS STRING) WHEN 8 THEN '1.2.3' ELSE '¥' || CAST(p_size AS STRING) || '.' END AS money,
 CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS STRING) || '/10' WHEN 1 THEN 'Rated ' || CAST(p_size % 6 AS STRING) || '.5' WHEN 2 THEN CAST(p_size * 2 AS STRING) WHEN 3 THEN 'none' WHEN 4 THEN CAST(p_size * 5 AS STRING) ELSE '-3' END AS stars,
 CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) || ',' || CAST(100 + p_size AS STRING) || ' reviews' WHEN 1 THEN 'no reviews' WHEN 2 THEN '-' || CAST(p_size AS STRING) WHEN 3 THEN CAST(p_size AS STRING) || '.9' ELSE '99999999999999999999' END AS counts,
 CASE p_partkey % 8 WHEN 0 THEN 'Availability: Available' WHEN 1 THEN 'currently unavailable' WHEN 2 THEN 'IN STOCK' WHEN 3 THEN 'Notify me' WHEN 4 THEN 'Preorder now' WHEN 5 THEN 'on backorder' WHEN 6 THEN '   ' ELSE 'Soon' END AS stock,
 CASE p_partkey % 6 WHEN 0 THEN '/p/' || CAST(p_partkey AS STRING) WHEN 1 THEN 'http://a.example/x' WHEN 2 THEN '//cdn.example/i' WHEN 3 THEN '' WHEN 4 THEN 'p/' || CAST(p_size AS STRING) || '?z=1' ELSE '../up' END AS link,
 '  ' || p_name || '   ' || p_type || ' ' AS words
FROM {part}"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RECORDS, part=_table(spark, sf_dir, "part"))
    empty = F.create_map().cast("map<string,string>")
    return rows.withColumn("loose", F.when(F.col("loose_price"), F.create_map(F.lit("price"), F.lit("cheap"))).otherwise(empty)).drop("loose_price")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEXTS, part=_table(spark, sf_dir, "part"))


def _parsed(column: str, parse, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir).select("p_partkey", parse(column).alias(name))

    return query


def url_canonical(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", U.canonical("url").alias("canonical"))


def url_dup_groups(spark, sf_dir):
    return url_canonical(spark, sf_dir).groupBy("canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


def tracking_param_stats(spark, sf_dir):
    pairs = _table(spark, sf_dir, "pages").select(F.explode(F.split(U.part(F.trim("url"), 4), "&")).alias("p")).where("p != ''")
    return pairs.groupBy(F.substring_index("p", "=", 1).alias("param")).agg(F.count("*").alias("n")).select("param", "n", F.col("param").rlike(U.TRACKING).alias("tracking"))


def store_url_resolve(spark, sf_dir):
    layout, page = U.layout_and_page("url", "v1_healthy")
    return _table(spark, sf_dir, "pages").select("page_id", layout.alias("layout"), page.alias("page_no"))


def snapshot_meta(spark, sf_dir):
    return snapshot_keys(_table(spark, sf_dir, "pages")).select("page_id", "host", "content_sha", F.col("bytes").cast("bigint").alias("bytes"))


def rule_violations(spark, sf_dir):
    return violation_rows(records(spark, sf_dir), ["run"]).select("run", "pos", "field", "code")


def violations_by_code(spark, sf_dir):
    return _health(spark, sf_dir).select("run", F.explode("violations_by_code").alias("code", "n"))


def violations_by_field(spark, sf_dir):
    return _health(spark, sf_dir).select("run", F.explode("violations_by_field").alias("field", "n"))


def valid_record_rate(spark, sf_dir):
    return validate(records(spark, sf_dir)).groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.size("violations") == 0).alias("valid"))


def _health(spark, sf_dir, expected=100):
    return health(records(spark, sf_dir), ["run"], expected)


def null_rates(spark, sf_dir):
    """The counts behind the rates, which are rounded in the report."""
    return _health(spark, sf_dir).select("run", F.explode("null_counts").alias("field", "nulls"))


def health_components(spark, sf_dir):
    return _health(spark, sf_dir).select("run", "records_received", F.col("filled_cells").alias("filled"), F.col("valid_records").alias("valid"))


def health_status(spark, sf_dir):
    return _health(spark, sf_dir).select("run", "status")


def failure_signals(spark, sf_dir):
    return health(records(spark, sf_dir), ["run"], 100_000).select("run", F.explode("failure_signals").alias("s")).select("run", F.substring_index("s", ":", 1).alias("signal"))


def anomaly_signals(spark, sf_dir):
    same = records(spark, sf_dir).withColumns({"run": F.col("currency"), "price": F.lit(10.5), "product_name": F.lit("it's"), "product_url": F.lit("http://shop.example/p")})
    return health(same.where("run IS NOT NULL"), ["run"], None).select("run", F.explode("failure_signals").alias("signal")).where("signal LIKE 'identical%'")


def broken_field_list(spark, sf_dir):
    return _health(spark, sf_dir).select("run", F.array_join(broken_fields(0.2), ",").alias("broken"))


def _by_day(spark, sf_dir):
    """Runs by brand and residue, the even ones as baseline of the odd ones with prices cut."""
    rows = records(spark, sf_dir).withColumn("turn", F.col("pos") % 2)
    cut = (F.col("turn") == 1) & F.col("run").endswith("3")
    rows = rows.withColumns({"price": F.when(~cut, F.col("price")), "loose": F.when(cut, F.create_map().cast("map<string,string>")).otherwise(F.col("loose"))})
    report = health(rows, ["run", "turn"], None)
    return detect(report.where("turn = 1").drop("turn"), report.where("turn = 0").drop("turn"), ["run"], ["run"])


def detect_severity(spark, sf_dir):
    return _by_day(spark, sf_dir).select("run", "severity", "detected")


def newly_broken(spark, sf_dir):
    return _by_day(spark, sf_dir).select("run", F.array_join("evidence.newly_broken_fields", ",").alias("newly_broken"))


def detector_confusion(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return accuracy(labels.select((F.col("quality") == 0).alias("detected"), (F.col("toxic") == 1).alias("truth"))).select("tp", "tn", "fp", "fn")


def _repeated(spark, sf_dir):
    """Three records per part and some without a key, in pages of up to 60 records."""
    rows = records(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    keep = lambda f, k: F.when(F.col("k") != k, F.col(f)).alias(f)
    anonymous = F.col("pos") % 25 == 0
    return rows.select(
        (F.col("pos") - F.col("pos") % 20).alias("page"), (F.col("pos") % 20 * 3 + F.col("k")).alias("pos"), F.when(~anonymous & (F.col("pos") % 3 != 0), F.col("product_id")).alias("product_id"),
        F.when(~anonymous, F.col("product_name")).alias("product_name"), keep("price", 0), keep("currency", 1), keep("rating", 2), keep("review_count", 0), F.col("availability"),
        F.when(~anonymous & (F.col("pos") % 6 != 0), F.col("product_url")).alias("product_url"), keep("image_url", 2), F.create_map().cast("map<string,string>").alias("loose"),
    )


def dedupe_report(spark, sf_dir):
    return dedupe(_repeated(spark, sf_dir), ["page"])[1].select("page", "input_count", "output_count", "dropped_no_key", "merged_duplicates")


def dedupe_key_kinds(spark, sf_dir):
    report = dedupe(_repeated(spark, sf_dir), ["page"])[1]
    return report.select(F.explode("keys_by_kind").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))


def dedupe_fold(spark, sf_dir):
    return dedupe(_repeated(spark, sf_dir), ["page"])[0].select("page", "pos", "product_id", "product_name", "price", "currency", "rating", "review_count", "product_url", "image_url")


def _page_strategy() -> Strategy:
    css = lambda value, attr=None: Selector("css", value, attr)
    fields = {"product_name": css("article h1"), "currency": Selector("attr-on-self", "lang"), "availability": css("body > footer"), "product_url": css("nav li a", "href"), "image_url": Selector("xpath", "//head/meta/@charset")}
    return Strategy("page", "html", fields, "nav a")


def page_extract(spark, sf_dir):
    got = extract(_table(spark, sf_dir, "pages"), _page_strategy(), ["page_id"], deduplicate=False).records
    return got.select("page_id", F.col("product_name").alias("heading"), F.col("currency").alias("lang"), F.col("product_url").alias("first_link"), F.col("image_url").alias("charset"))


def page_facts(spark, sf_dir):
    got = extract(_table(spark, sf_dir, "pages"), _page_strategy(), ["page_id"], deduplicate=False).pages
    return got.select("page_id", F.col("raw_len").cast("bigint").alias("raw_len"), F.col("n_roots").cast("bigint").alias("n_roots"))


def dom_fingerprints(spark, sf_dir):
    return extract(_table(spark, sf_dir, "pages"), _page_strategy(), ["page_id"], deduplicate=False).pages.select("page_id", "fingerprint")


SITE = 20


def _products(spark, sf_dir, size=SITE):
    """Clean products of ``part`` as sites of ``size``, the golden records of the layouts."""
    rows = _table(spark, sf_dir, "part").where("p_partkey >= 0")
    name = F.concat_ws(" ", F.col("p_name"), F.lit("&"), F.col("p_partkey").cast("string"))
    link = lambda kind: F.concat(F.lit(f"http://127.0.0.1:8765/{kind}/"), F.col("p_partkey").cast("string"))
    return rows.select(
        F.floor(F.col("p_partkey") / size).alias("site"), (F.col("p_partkey") % size).cast("int").alias("pos"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"), name.alias("product_name"),
        F.round(F.col("p_partkey") % 5000 + F.lit(1.25), 2).alias("price"), F.lit("INR").alias("currency"), (F.col("p_size") % 5).cast("double").alias("rating"), (F.col("p_size") * 100).cast("bigint").alias("review_count"),
        F.when(F.col("p_size") % 4 == 0, "Out of Stock").otherwise("In Stock").alias("availability"), link("p").alias("product_url"), link("img").alias("image_url"), F.create_map().cast("map<string,string>").alias("loose"),
    )


def _site_records(spark, sf_dir):
    pages = layout_pages(_products(spark, sf_dir), ["site"])
    got = extract(pages, default_strategy(), ["site", "layout", "page_no"]).records
    # a full page has ten cards, so the place within the site follows from page and place
    return got.withColumn("pos", ((F.col("page_no") - 1) * 10 + F.col("pos")).cast("int"))


def layout_extract(spark, sf_dir):
    return _site_records(spark, sf_dir).select("site", "layout", "product_id", *FIELDS)


def layout_health(spark, sf_dir):
    return health(_site_records(spark, sf_dir), ["site", "layout"], SITE).select("site", "layout", "status", F.array_join(broken_fields(), ",").alias("broken"))


def layout_accuracy(spark, sf_dir):
    got, golden = _site_records(spark, sf_dir), _products(spark, sf_dir)
    same = sum(((F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).cast("int") for f in FIELDS), F.lit(0))
    both = got.alias("a").join(large(golden).alias("b"), (F.col("a.site") == F.col("b.site")) & (F.col("a.pos") == F.col("b.pos")))
    return both.groupBy("a.layout").agg(F.sum(same).cast("bigint").alias("right"), (F.count("*") * len(FIELDS)).alias("cells"))


def _sick(spark, sf_dir):
    """First pages of every site's breaking layouts with the fields that break there."""
    pages = layout_pages(_products(spark, sf_dir), ["site"], [k for k, broken in LAYOUTS.items() if broken]).where("page_no = 1")
    lists = {"v2_rename_class": ["price"], "v9_combined": ["price"], "v10_partial": ["availability"], "v3_dataattr": ["availability", "currency", "price", "product_name", "rating", "review_count"]}
    broken = F.coalesce(*[F.when(F.col("layout") == k, F.array(*[F.lit(f) for f in fields])) for k, fields in lists.items()])
    return pages.withColumns({"broken_fields": broken, "strategy": F.lit(default_strategy().to_json())})


def _golden(spark, sf_dir):
    """The products of the first pages, by the places that their cards have there."""
    rows = _products(spark, sf_dir).where("pos < 10")
    first = rows.groupBy("site").agg(F.min("pos").alias("_first"))
    return rows.join(large(first), "site").withColumn("pos", (F.col("pos") - F.col("_first")).cast("int")).drop("_first")


def _repairs(spark, sf_dir):
    return repair(_sick(spark, sf_dir), ["site", "layout"], golden=_golden(spark, sf_dir), site=["site"])


def candidate_counts(spark, sf_dir):
    return _repairs(spark, sf_dir)[0].select("site", "layout", "field", F.col("generated").cast("bigint").alias("generated"), F.col("candidate_count").cast("bigint").alias("kept"))


def repair_winners(spark, sf_dir):
    return _repairs(spark, sf_dir)[0].select("site", "layout", "field", "kind", "value", "source", "total", "action")


def top_candidates(spark, sf_dir):
    return _repairs(spark, sf_dir)[1].where("rank <= 5").select("site", "layout", "field", "rank", "value", "total")


def benchmark_summary(spark, sf_dir):
    """Baseline and healing over all sites of 20 products and all layouts."""
    products = _products(spark, sf_dir)
    full = products.join(products.groupBy("site").count().where(F.col("count") == SITE), "site", "left_semi")
    summary = benchmark.run(layout_pages(full, ["site"]), full, SITE, site=["site"])[1]
    return summary.select("system", "runs", F.round("avg_completeness", 3).alias("avg_completeness"), F.round("avg_field_accuracy", 3).alias("avg_field_accuracy"), "healthy_runs", "repair_attempts", "repair_successes", "false_repairs")


def _log(spark, sf_dir):
    """Events as the log of scrapers: user_id is the scraper, event_type the action."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "ts", "event_type", "value")


def scraper_state(spark, sf_dir):
    return current(_log(spark, sf_dir)).select("id", "seq", "event_type", "value")


def latest_runs(spark, sf_dir):
    runs = _log(spark, sf_dir).where("event_type = 'view'").select(F.col("id").alias("scraper"), F.col("seq").alias("id"), F.col("ts").alias("timestamp"))
    return latest(runs, 3, per="scraper").select("scraper", "id")


def repair_history(spark, sf_dir):
    repairs = _log(spark, sf_dir).where("event_type = 'error'").select(F.col("id").alias("scraper"), F.col("seq").alias("id"), F.col("ts").alias("timestamp"))
    return latest(repairs, 50).select("scraper", "id")


def version_numbers(spark, sf_dir):
    """A version per signup or purchase, numbered within the scraper."""
    rows = _log(spark, sf_dir).where("event_type IN ('signup', 'purchase')")
    return rows.select("id", "seq", F.row_number().over(Window.partitionBy("id").orderBy("seq")).alias("version"))


def rollback_state(spark, sf_dir):
    """Current version by scraper: an error rolls back to version 1, other events go on to the newest."""
    rows = _log(spark, sf_dir)
    deployed = F.count_if(F.col("event_type").isin("signup", "purchase"))
    state = rows.groupBy("id").agg(deployed.alias("versions"), F.max_by("event_type", "seq").alias("last"))
    return state.select("id", "versions", F.when(F.col("last") == "error", F.least(F.lit(1), F.col("versions"))).otherwise(F.col("versions")).alias("current_version"))


def similarity_lengths(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("field", F.lit("product_name"))
    return field_scores(rows, ["run"]).select("run", "similarity", "completeness")


def historical_overlap(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("field", F.lit("availability"))
    past = rows.where("pos % 10 = 0").select("field", F.col("availability").alias("value"))
    return field_scores(rows, ["run"], historical=past).select("run", F.round("historical_consistency", 3).alias("consistency"))


def golden_accuracy(spark, sf_dir):
    rows = records(spark, sf_dir)
    golden = rows.withColumns({"price": F.round(F.coalesce("price", F.lit(1.0)), 2), "loose": F.create_map().cast("map<string,string>")}).drop("run")
    return field_accuracy(rows, golden, ["run"]).select("run", F.round("field_accuracy", 3).alias("field_accuracy"))


def event_rates(spark, sf_dir):
    """The batch form of the streaming rates: events by hour and type."""
    rows = _table(spark, sf_dir, "events")
    return rows.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))


QUERIES = {
    "price_parse": _parsed("money", N.parse_price, "price"),
    "currency_parse": _parsed("money", N.parse_currency, "currency"),
    "rating_parse": _parsed("stars", N.parse_rating, "rating"),
    "int_parse": _parsed("counts", N.parse_int, "review_count"),
    "availability_parse": _parsed("stock", N.parse_availability, "availability"),
    "url_resolve": _parsed("link", lambda c: U.resolve(c, F.lit("http://s.example")), "link"),
    "text_clean": _parsed("words", N.parse_text, "words"),
    **{q.__name__: q for q in (
        url_canonical, url_dup_groups, tracking_param_stats, store_url_resolve, snapshot_meta, rule_violations, violations_by_code, violations_by_field, valid_record_rate,
        null_rates, health_components, health_status, failure_signals, anomaly_signals, broken_field_list, detect_severity, newly_broken, detector_confusion,
        dedupe_report, dedupe_key_kinds, dedupe_fold, page_extract, page_facts, dom_fingerprints, layout_extract, layout_health, layout_accuracy,
        candidate_counts, repair_winners, top_candidates, scraper_state, latest_runs, repair_history, version_numbers, rollback_state,
        similarity_lengths, historical_overlap, golden_accuracy, event_rates, benchmark_summary,
    )},
}

