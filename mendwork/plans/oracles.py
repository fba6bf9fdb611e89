"""DuckDB SQL for the queries of ``catalog``, over the same tables."""

from __future__ import annotations

from .catalog import RECORDS, TEXTS

_R = f"r AS ({RECORDS.format(part='part')})"
_T = f"t AS ({TEXTS.format(part='part')})"

_TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|mc_[a-z]+|ref|ref_src|source|sessionid|sid|hsctatracking)$"
_CANONICAL = rf"""c AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://[^/?#]*')) || regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)
 || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END, '/+$', '') AS canonical
 FROM (SELECT page_id, trim(url) AS u, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
  lambda p: split_part(p, '=', 1) <> '' AND NOT regexp_matches(split_part(p, '=', 1), '{_TRACKING}'))) AS q FROM pages))"""

_N = r"regexp_extract(trim({0}), '[-+]?\d[\d,\.]*')"


def _price(column: str) -> str:
    n = _N.format(column)
    return rf"""try_cast(CASE WHEN contains({n}, ',') AND contains({n}, '.') THEN CASE WHEN instr(reverse({n}), ',') < instr(reverse({n}), '.')
 THEN replace(replace({n}, '.', ''), ',', '.') ELSE replace({n}, ',', '') END WHEN regexp_matches({n}, '^\d{{1,3}},\d{{2}}$') THEN replace({n}, ',', '.') ELSE replace({n}, ',', '') END AS DOUBLE)"""


def _contains(column: str, pairs: list[tuple[str, str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{k}') THEN '{v}'" for k, v in pairs) + f" ELSE {rest} END"


_CURRENCY = _contains("upper(money)", [("₹", "INR"), ("RS.", "INR"), ("INR", "INR"), ("$", "USD"), ("USD", "USD"), ("€", "EUR"), ("EUR", "EUR"), ("£", "GBP"), ("GBP", "GBP"), ("¥", "JPY"), ("JPY", "JPY")], "NULL")
_STOCK = _contains(
    "lower(CASE WHEN contains(stock, ':') THEN substr(stock, instr(stock, ':') + 1) ELSE stock END)",
    [("out of stock", "Out of Stock"), ("unavailable", "Out of Stock"), ("available", "In Stock"), ("backorder", "Backorder"), ("in stock", "In Stock"), ("preorder", "Preorder"), ("yes", "In Stock"), ("no", "Out of Stock")],
    "stock",
)

# one SELECT per rule; loose_price marks a price of the wrong type
_PRICE = "price IS NOT NULL AND price"
_RULES = [
    *[(f, "missing", f"{f} IS NULL OR CAST({f} AS VARCHAR) = ''") for f in ("product_name", "currency", "rating", "review_count", "availability", "product_url", "image_url")],
    ("price", "missing", "price IS NULL AND NOT loose_price"), ("price", "wrong_type", "loose_price"),
    ("price", "negative", f"{_PRICE} < 0"), ("price", "implausibly_high", f"{_PRICE} > 10000000"), ("price", "placeholder_zero", f"{_PRICE} = 0"),
    ("price", "placeholder_penny", f"{_PRICE} = 0.01"), ("price", "placeholder_sentinel", f"{_PRICE} >= 9999999"),
    ("rating", "out_of_range", "rating < 0 OR rating > 5"), ("review_count", "negative", "review_count < 0"),
    *[(f, "invalid_url", f"{f} IS NOT NULL AND NOT regexp_matches({f}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+')") for f in ("product_url", "image_url")],
    ("product_name", "looks_like_ui", "lower(trim(product_name)) IN ('add to cart', 'buy now', 'wishlist', 'compare', 'n/a')"),
    ("product_name", "too_short", "length(trim(product_name)) = 1"),
    ("product_name", "placeholder_text", "lower(trim(product_name)) IN ('n/a', 'na', 'null', 'undefined', 'unknown', 'tbd', 'todo', 'placeholder', 'sample', 'example', 'test', 'lorem ipsum', 'xxx', '???')"),
    ("product_name", "html_leak", "regexp_matches(product_name, '(?i)<[a-z/][a-z0-9]*[^>]*>')"),
    ("currency", "not_iso4217", "currency IS NOT NULL AND NOT regexp_matches(currency, '^[A-Z]{3}$')"),
]
_V = "v AS (" + " UNION ALL ".join(f"SELECT run, pos, '{f}' AS field, '{c}' AS code FROM r WHERE {w}" for f, c, w in _RULES) + ")"
_FIELDS = ("product_name", "price", "currency", "rating", "review_count", "availability", "product_url", "image_url")


def _empty(f: str) -> str:
    return "CAST(price IS NULL AND NOT loose_price AS INT)" if f == "price" else f"CAST({f} IS NULL OR CAST({f} AS VARCHAR) = '' AS INT)"


def _given(f: str) -> str:
    return "CAST(price IS NOT NULL OR loose_price AS INT)" if f == "price" else f"CAST({f} IS NOT NULL AS INT)"


_H = f"""h AS (SELECT r.run, count(*) AS n, 1.0::DOUBLE - sum({' + '.join(map(_empty, _FIELDS))})::DOUBLE / (count(*) * 8) AS c,
 count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.run = r.run AND v.pos = r.pos))::DOUBLE / count(*) AS vd,
 1.0::DOUBLE - sum(CAST(loose_price AS INT))::DOUBLE / sum({' + '.join(map(_given, _FIELDS))}) AS s, greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(count(*) - 100)::DOUBLE / 100) AS rc FROM r GROUP BY r.run)"""
_SCORE = "(0.30::DOUBLE * c + 0.30::DOUBLE * vd + 0.20::DOUBLE * s + 0.20::DOUBLE * rc)"

_BROKEN = {"v2_rename_class": ("price",), "v9_combined": ("price",), "v10_partial": ("availability",), "v3_dataattr": ("availability", "currency", "price", "product_name", "rating", "review_count")}
_LAYOUTS = ("v1_healthy", "v2_rename_class", "v3_dataattr", "v4_change_nesting", "v5_move_price", "v6_label_change", "v7_decoy", "v8_pagination", "v9_combined", "v10_partial", "v11_semantic")
_L = "l AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _LAYOUTS) + "]) AS layout)"
_P = """p AS (SELECT p_partkey // 20 AS site, 'P' || p_partkey AS product_id, p_name || ' & ' || p_partkey AS product_name, round(p_partkey % 5000 + 1.25, 2)::DOUBLE AS price, 'INR' AS currency,
 (p_size % 5)::DOUBLE AS rating, (p_size * 100)::BIGINT AS review_count, CASE WHEN p_size % 4 = 0 THEN 'Out of Stock' ELSE 'In Stock' END AS availability,
 'http://127.0.0.1:8765/p/' || p_partkey AS product_url, 'http://127.0.0.1:8765/img/' || p_partkey AS image_url FROM part WHERE p_partkey >= 0)"""


def _shown(f: str) -> str:
    lost = [f"'{k}'" for k, fields in _BROKEN.items() if f in fields]
    return f"CASE WHEN layout IN ({', '.join(lost)}) THEN NULL ELSE {f} END AS {f}" if lost else f


_BROKEN_LIST = "CASE layout " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in _BROKEN.items()) + " ELSE '' END"
_GENERATED = {"price": 32, "availability": 19}
_V3 = {"availability": 16, "currency": 13, "price": 27, "product_name": 24, "rating": 18, "review_count": 16}
_COUNTS = [(k, f, _V3[f] if k == "v3_dataattr" else _GENERATED[f]) for k, fields in _BROKEN.items() for f in fields]

# Repair with golden records. What a candidate finds on a card follows from the layout: the right value (similarity 1), another one
# that is plausible or not, or nothing (0.075, the half of the weight of a missing history). Parts of a site's first page:
# r: ratings above 0, k: product numbers above 0, q: prices whose first digits are a rating (up to 100, or before a comma), g: the
# same rating, e and f: review counts equal to the number and to the price's integer.
_SITES = """p AS (SELECT p_partkey // 20 AS site, avg(CAST(p_size % 5 > 0 AS INT)) AS r, avg(CAST(p_partkey > 0 AS INT)) AS k, avg(CAST(p_partkey % 5000 + 1.25 <= 100 OR p_partkey % 5000 + 1.25 >= 1000 AS INT)) AS q,
 avg(CAST(p_partkey % 5000 + 1.25 >= 1000 AND (p_partkey % 5000 + 1) // 1000 = p_size % 5 AS INT)) AS g,
 avg(CAST(p_partkey = p_size * 100 AS INT)) AS e, avg(CAST(p_partkey % 5000 + 1 = p_size * 100 AS INT)) AS f FROM part WHERE p_partkey >= 0 AND p_partkey % 20 < 10 GROUP BY ALL)"""
_RIGHT, _WRONG, _NOTHING = "0.925", "0.775", "0.075"
_FOUND = [
    *[("v2_rename_class", "price", n, v, _RIGHT) for n, v in ((29, ".cost"), (30, "span.cost"), (67, "span:nth-of-type(1)"), (69, "div:nth-of-type(1)"))], ("v2_rename_class", "price", 70, "div:nth-of-type(2)", "0.525 + 0.25 * r"),
    *[("v9_combined", "price", n, v, _RIGHT) for n, v in ((30, "span.cost"), (67, "span:nth-of-type(1)"))], ("v9_combined", "price", 29, ".cost", _WRONG),
    *[("v9_combined", "price", n, v, "0.525 + 0.25 * k") for n, v in ((69, "div:nth-of-type(1)"), (70, "div:nth-of-type(2)"))],
    *[("v10_partial", "availability", n, v, _RIGHT) for n, v in ((21, ".stock-status"), (22, "div.stock-status"))],
    *[(k, "availability", n, v, _WRONG) for k in ("v10_partial", "v3_dataattr") for n, v in ((31, "Stock"), (32, "div:nth-of-type(1)"), (33, "div:nth-of-type(2)"), (34, "span:nth-of-type(1)"), (35, "span:nth-of-type(2)"))],
    *[("v3_dataattr", f, n, v, _RIGHT) for f, n, v in (
        ("availability", 0, "[data-testid='availability']"), ("currency", 0, "[data-testid='currency']"), ("currency", 23, "span:nth-of-type(2)"), ("price", 0, "[data-testid='price']"), ("price", 67, "span:nth-of-type(1)"),
        ("price", 69, "div:nth-of-type(1)"), ("product_name", 3, "[data-testid='title']"), ("product_name", 50, "h3"), ("product_name", 56, "h3:nth-of-type(1)"), ("rating", 0, "[data-testid='rating']"), ("rating", 40, "div:nth-of-type(2)"),
        ("review_count", 0, "[data-testid='review-count']"),
    )],
    ("v3_dataattr", "currency", 22, "span:nth-of-type(1)", "0.525"), ("v3_dataattr", "price", 70, "div:nth-of-type(2)", "0.525 + 0.25 * r"),
    *[("v3_dataattr", "rating", n, v, "0.075 + 0.7 * q + 0.15 * g") for n, v in ((37, "span:nth-of-type(1)"), (39, "div:nth-of-type(1)"))],
    ("v3_dataattr", "review_count", 30, "reviews", "0.775 + 0.15 * e"), ("v3_dataattr", "review_count", 35, "div:nth-of-type(2)", _WRONG),
    *[("v3_dataattr", "review_count", n, v, "0.775 + 0.15 * f") for n, v in ((32, "span:nth-of-type(1)"), (34, "div:nth-of-type(1)"))],
    *[("v3_dataattr", f, n, v, _NOTHING) for f, own in (
        ("currency", ((2, "[itemprop='currency']"), (3, "[data-testid='ccy']"))), ("price", ((2, "[itemprop='price']"),)), ("product_name", ((0, "[data-testid='name']"), (2, "[itemprop='name']"))),
        ("rating", ((2, "[itemprop='rating']"), (3, "[data-testid='stars']"), (5, "[itemprop='stars']"))),
    ) for n, v in own],
]
_CANDIDATES = "c AS (" + " UNION ALL ".join(f"SELECT site, '{k}' AS layout, '{f}' AS field, {n} AS ord, '{v.replace(chr(39), chr(39) * 2)}' AS value, round_even(CAST({t} AS DOUBLE), 4) AS total FROM p" for k, f, n, v, t in _FOUND) + "), x AS (SELECT *, CAST(row_number() OVER (PARTITION BY site, layout, field ORDER BY total DESC, ord) AS INT) AS rank FROM c)"

_D = """d AS (SELECT pos - pos % 20 AS page, pos % 20 * 3 + k AS pos, CASE WHEN pos % 25 <> 0 AND pos % 3 <> 0 THEN product_id END AS product_id, CASE WHEN pos % 25 <> 0 THEN product_name END AS product_name,
 CASE WHEN k <> 0 THEN price END AS price, CASE WHEN k <> 1 THEN currency END AS currency, CASE WHEN k <> 2 THEN rating END AS rating, CASE WHEN k <> 0 THEN review_count END AS review_count, availability,
 CASE WHEN pos % 25 <> 0 AND pos % 6 <> 0 THEN product_url END AS product_url, CASE WHEN k <> 2 THEN image_url END AS image_url FROM r, (SELECT unnest([0, 1, 2]) AS k)),
 e AS (SELECT *, CASE WHEN product_id <> '' THEN 'id:' || product_id WHEN product_url <> '' THEN 'url:' || rtrim(product_url, '/')
  WHEN trim(product_name) <> '' THEN 'hash:' || lower(trim(product_name)) || '|' || coalesce(product_url, 'None') END AS key,
  CAST(coalesce(product_name, '') <> '' AS INT) + CAST(price IS NOT NULL AS INT) + CAST(coalesce(currency, '') <> '' AS INT) + CAST(rating IS NOT NULL AS INT) + CAST(review_count IS NOT NULL AS INT)
  + CAST(coalesce(availability, '') <> '' AS INT) + CAST(coalesce(product_url, '') <> '' AS INT) + CAST(coalesce(image_url, '') <> '' AS INT) AS filled FROM d)"""

_DF = ("product_id", "product_name", "price", "currency", "rating", "review_count", "product_url", "image_url", "availability")


def _merged(f: str, a: str, b: str) -> str:
    if f in ("price", "rating", "review_count"):
        return f"coalesce({a}.{f}, {b}.{f})"
    return f"CASE WHEN {a}.{f} <> '' THEN {a}.{f} WHEN {b}.{f} <> '' THEN {b}.{f} ELSE {a}.{f} END"


_FILLED = " + ".join(f"CAST({{0}}.{f} IS NOT NULL AS INT)" if f in ("price", "rating", "review_count") else f"CAST(coalesce({{0}}.{f}, '') <> '' AS INT)" for f in _DF if f != "product_id")
_PACK = lambda a, b: "struct_pack(" + ", ".join(f"{f} := {_merged(f, a, b)}" for f in _DF) + ")"
_FOLD = f"""SELECT page, row_number() OVER (PARTITION BY page ORDER BY first) - 1 AS pos, x.product_id, x.product_name, x.price, x.currency, x.rating, x.review_count, x.product_url, x.image_url
FROM (SELECT page, key, min(pos) AS first, list_reduce(list(struct_pack({', '.join(f'{f} := {f}' for f in _DF)}) ORDER BY pos),
 lambda a, y: CASE WHEN {_FILLED.format('y')} > {_FILLED.format('a')} THEN {_PACK('y', 'a')} ELSE {_PACK('a', 'y')} END) AS x FROM e WHERE key IS NOT NULL GROUP BY page, key)"""

_B = "b AS (SELECT *, pos % 2 AS turn, CASE WHEN pos % 2 = 1 AND run LIKE '%3' THEN NULL ELSE price END AS p2, loose_price AND NOT (pos % 2 = 1 AND run LIKE '%3') AS l2 FROM r)"

ORACLES = {
    "price_parse": f"WITH {_T} SELECT p_partkey, CASE WHEN {_price('money')} >= 0 THEN {_price('money')} END AS price FROM t",
    "currency_parse": f"WITH {_T} SELECT p_partkey, {_CURRENCY} AS currency FROM t",
    "rating_parse": rf"WITH {_T}, x AS (SELECT p_partkey, try_cast(regexp_extract(stars, '\d+(\.\d+)?') AS DOUBLE) AS v FROM t) SELECT p_partkey, CASE WHEN v <= 5 THEN v WHEN v <= 10 THEN v / 2 WHEN v <= 100 THEN v / 20 END AS rating FROM x",
    "int_parse": f"WITH {_T}, x AS (SELECT p_partkey, try_cast(split_part(replace({_N.format('counts')}, ',', ''), '.', 1) AS BIGINT) AS v FROM t) SELECT p_partkey, CASE WHEN v >= 0 THEN v END AS review_count FROM x",
    "availability_parse": f"WITH {_T} SELECT p_partkey, CASE WHEN trim(stock) <> '' THEN {_STOCK} END AS availability FROM t",
    "url_resolve": f"WITH {_T} SELECT p_partkey, CASE WHEN link = '' THEN NULL WHEN link LIKE 'http%' THEN link WHEN link LIKE '//%' THEN 'http:' || link WHEN link LIKE '/%' THEN 'http://s.example' || link WHEN link = '../up' THEN 'http://s.example/up' ELSE 'http://s.example/' || link END AS link FROM t",
    "text_clean": rf"WITH {_T} SELECT p_partkey, nullif(trim(regexp_replace(words, '\s+', ' ', 'g')), '') AS words FROM t",
    "url_canonical": f"WITH {_CANONICAL} SELECT page_id, canonical FROM c",
    "url_dup_groups": f"WITH {_CANONICAL} SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM c GROUP BY canonical HAVING count(*) > 1",
    "tracking_param_stats": rf"WITH x AS (SELECT unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages) SELECT split_part(p, '=', 1) AS param, count(*) AS n, regexp_matches(split_part(p, '=', 1), '{_TRACKING}') AS tracking FROM x WHERE p <> '' GROUP BY ALL",
    "store_url_resolve": r"SELECT page_id, 'v1_healthy' AS layout, coalesce(try_cast(nullif(regexp_extract(url, '(?:[?&]page=|/page-|/list/)(\d+)', 1), '') AS INT), 1) AS page_no FROM pages",
    "snapshot_meta": r"SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '[^A-Za-z0-9._-]', '_', 'g') AS host, substr(sha256(html), 1, 16) AS content_sha, length(html) AS bytes FROM pages",
    "rule_violations": f"WITH {_R}, {_V} SELECT run, pos, field, code FROM v",
    "violations_by_code": f"WITH {_R}, {_V} SELECT run, code, count(*) AS n FROM v GROUP BY run, code",
    "violations_by_field": f"WITH {_R}, {_V} SELECT run, field, count(*) AS n FROM v GROUP BY run, field",
    "valid_record_rate": f"WITH {_R}, {_V} SELECT r.run, count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.run = r.run AND v.pos = r.pos)) AS valid FROM r GROUP BY r.run",
    "null_rates": f"WITH {_R} " + " UNION ALL ".join(f"SELECT run, '{f}' AS field, CAST(sum({_empty(f)}) AS BIGINT) AS nulls FROM r GROUP BY run" for f in _FIELDS),
    "health_components": f"WITH {_R}, {_V}, {_H} SELECT run, n AS records_received, CAST(round(c * n * 8) AS BIGINT) AS filled, CAST(round(vd * n) AS BIGINT) AS valid FROM h",
    "health_status": f"WITH {_R}, {_V}, {_H} SELECT run, CASE WHEN {_SCORE} >= 0.9 THEN 'healthy' WHEN {_SCORE} >= 0.7 THEN 'warning' ELSE 'repair_required' END AS status FROM h",
    "failure_signals": f"WITH {_R}, {_V}, {_H}, f AS (SELECT run, field, count(*) AS k FROM v GROUP BY run, field) SELECT run, 'record_count_collapse' AS signal FROM h WHERE n < 50000 UNION ALL SELECT run, 'low_completeness' FROM h WHERE c < 0.5 UNION ALL SELECT DISTINCT f.run, 'field_widely_broken' FROM f JOIN h USING (run) WHERE k::DOUBLE / n >= 0.8 UNION ALL SELECT DISTINCT run, 'type_drift' FROM v WHERE code = 'wrong_type'",
    "anomaly_signals": f"WITH {_R}, g AS (SELECT currency AS run, count(*) AS n FROM r WHERE currency IS NOT NULL GROUP BY currency HAVING count(*) >= 3) SELECT run, unnest(['identical_prices:10.5', 'identical_product_urls', 'identical_product_names:\"it''s\"']) AS signal FROM g",
    "broken_field_list": f"WITH {_R}, {_V}, {_H}, f AS (SELECT run, field, count(*) AS k FROM v GROUP BY run, field) SELECT h.run, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE k::DOUBLE / n >= 0.2), '') AS broken FROM h LEFT JOIN f USING (run) GROUP BY h.run",
    "newly_broken": f"WITH {_R}, {_B}, g AS (SELECT run, turn, " + ", ".join(f"avg({'CAST(p2 IS NULL AND NOT l2 AS INT)' if f == 'price' else _empty(f)}) AS {f}" for f in _FIELDS) + " FROM b GROUP BY run, turn) SELECT a.run, concat_ws(',', " + ", ".join(f"CASE WHEN a.{f} >= 0.5 AND coalesce(z.{f}, 0) < 0.5 THEN '{f}' END" for f in sorted(_FIELDS)) + ") AS newly_broken FROM g a LEFT JOIN g z ON z.run = a.run AND z.turn = 0 WHERE a.turn = 1",
    "detector_confusion": "SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 0 AND toxic <> 1) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic <> 1) AS fp, count(*) FILTER (WHERE quality <> 0 AND toxic = 1) AS fn FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "dedupe_report": f"WITH {_R}, {_D} SELECT page, count(*) AS input_count, count(DISTINCT key) AS output_count, count(*) - count(key) AS dropped_no_key, count(key) - count(DISTINCT key) AS merged_duplicates FROM e GROUP BY page",
    "dedupe_key_kinds": f"WITH {_R}, {_D} SELECT split_part(key, ':', 1) AS kind, count(*) AS n FROM e WHERE key IS NOT NULL GROUP BY kind",
    "dedupe_fold": f"WITH {_R}, {_D} {_FOLD}",
    "page_facts": "SELECT page_id, length(html) AS raw_len, CAST(contains(html, '<html') AS BIGINT) AS n_roots FROM pages",
    "layout_extract": f"WITH {_P}, {_L} SELECT site, layout, product_id, {', '.join(map(_shown, _FIELDS))} FROM p, l",
    "layout_health": f"WITH {_P}, {_L} SELECT site, layout, CASE WHEN {_BROKEN_LIST} <> '' THEN CASE WHEN 0.3 * (1 - CASE WHEN layout = 'v3_dataattr' THEN 6 ELSE 1 END / 8.0) + 0.2 + 0.2 * count(*) / 20 >= 0.7 THEN 'warning' ELSE 'repair_required' END WHEN 0.8::DOUBLE + 0.2::DOUBLE * count(*) / 20 >= 0.9 THEN 'healthy' ELSE 'warning' END AS status, {_BROKEN_LIST} AS broken FROM p, l GROUP BY site, layout",
    "layout_accuracy": f"WITH {_P}, {_L} SELECT layout, CAST(count(*) * CASE layout WHEN 'v3_dataattr' THEN 2 " + " ".join(f"WHEN '{k}' THEN 7" for k in _BROKEN if k != "v3_dataattr") + " ELSE 8 END AS BIGINT) AS \"right\", count(*) * 8 AS cells FROM p, l GROUP BY layout",
    "candidate_counts": f"WITH {_P}, c(layout, field, generated) AS (VALUES {', '.join(f'({k!r}, {f!r}, {n})' for k, f, n in _COUNTS)}) SELECT DISTINCT site, layout, field, CAST(generated AS BIGINT) AS generated, CAST(5 AS BIGINT) AS kept FROM p, c WHERE site IN (SELECT (p_partkey // 20) FROM part WHERE p_partkey % 20 < 10)",
    "top_candidates": f"WITH {_SITES}, {_CANDIDATES} SELECT site, layout, field, rank, value, total FROM x WHERE rank <= 5",
    "repair_winners": f"WITH {_SITES}, {_CANDIDATES} SELECT site, layout, field, 'css' AS kind, value, CASE WHEN value LIKE '[%' THEN 'attr' ELSE 'class-synonym' END AS source, total, 'promote' AS action FROM x WHERE rank = 1",
    # the published rows: 7 of 11 layouts healthy without healing, all with it, 4 repairs of 4, none false
    "benchmark_summary": "WITH s AS (SELECT count(*) AS n FROM (SELECT p_partkey // 20 FROM part GROUP BY ALL HAVING count(*) = 20)) SELECT 'baseline' AS system, 11 * n AS runs, 0.898::DOUBLE AS avg_completeness, 0.898::DOUBLE AS avg_field_accuracy, 7 * n AS healthy_runs, 0 * n AS repair_attempts, 0 * n AS repair_successes, 0 * n AS false_repairs FROM s UNION ALL SELECT 'healing', 11 * n, 1.0, 1.0, 11 * n, 4 * n, 4 * n, 0 * n FROM s",
    "scraper_state": "SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "latest_runs": "SELECT user_id AS scraper, event_id AS id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "repair_history": "SELECT user_id AS scraper, event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "version_numbers": "SELECT user_id AS id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE event_type IN ('signup', 'purchase')",
    "rollback_state": "WITH s AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS versions, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) SELECT id, versions, CASE WHEN last = 'error' THEN least(1, versions) ELSE versions END AS current_version FROM s",
    "similarity_lengths": f"WITH {_R} SELECT run, round_even(CASE WHEN avg(length(product_name)) = 0 THEN 0 ELSE greatest(0, least(1, 1 - stddev_pop(length(product_name)) / greatest(avg(length(product_name)), 1))) END, 4) AS similarity, round_even(avg(CAST(product_name <> '' AS INT)), 4) AS completeness FROM r GROUP BY run",
    "historical_overlap": f"WITH {_R} SELECT run, round(avg(CAST(availability IN (SELECT availability FROM r WHERE pos % 10 = 0) AS INT)), 3) AS consistency FROM r GROUP BY run",
    "golden_accuracy": f"WITH {_R} SELECT run, round(avg((7 + CASE WHEN loose_price THEN 0 WHEN price IS NULL THEN 0 WHEN round(price, 2) = price THEN 1 ELSE 0 END) / 8.0), 3) AS field_accuracy FROM r GROUP BY run",
    "event_rates": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
