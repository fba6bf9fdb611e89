"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import attribution, decontaminate, fixity, gam, language, line_runs, main_text, mixing, packing, periodic, quality_rules, simhash, spelling
from .common import cut_lineage, held_out, remainder, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = cut_lineage(quality_rules.with_stats(docs).drop("text"))
    model = quality_rules.fit(stats)
    return quality_rules.with_posterior(stats, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.base_failed().alias("base_failed"), quality_rules.kept().alias("kept"), "quality_prob",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = mixing.score_texts(docs, training=remainder("doc_id", 5) != 1)
    return scored.select("doc_id", held_out("doc_id", 5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_items") > 0).alias("contaminated"),
    )


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records of files of 1,000, and a replica in which some are altered or missing."""
    record = F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    altered = F.when(F.col("page_id") % 97 == 5, F.concat(record, F.lit("x"))).otherwise(record)
    (size, own), (_, other) = fixity.digest_of(record), fixity.digest_of(altered)
    # both replicas' bytes are hashed where the pages are read; what moves is a row of hashes
    file = F.floor(F.col("page_id") / 1000)
    hashed = table(spark, sf_dir, "pages").select("page_id", file.cast("string").alias("file"), size.alias("bytes"), own.alias("a"), other.alias("b"))
    before = Window.partitionBy("file").orderBy("page_id", "bytes", "a").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut_lineage(hashed.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0))))
    first = fixity.placed(rows.select("file", "offset", "bytes", F.col("a").alias("hash")))
    second = fixity.placed(rows.where(F.col("page_id") % 89 != 7).select("file", "offset", "bytes", F.col("b").alias("hash")))
    roots, damage = fixity.audit(first, second)
    listed = damage.groupBy("file").agg(F.count("*").alias("n_damaged"), F.array_join(F.array_sort(F.collect_list(F.format_string("%010d:%s", "offset", "status"))), ",").alias("damaged"))
    return roots.join(listed, "file", "left").select("file", "records", "bytes", "root_a", "root_b", "intact", F.coalesce("n_damaged", F.lit(0)).cast("long").alias("n_damaged"), F.coalesce("damaged", F.lit("")).alias("damaged"))


def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = attribution.token_counts(table(spark, sf_dir, "documents"), rule="majority")
    return counted.select("doc_id", "section", "start", "length", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"))
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.fit_labels(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    scored = gam.with_scores(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(remainder("doc_id", 3) != 1))
    found = language.with_languages(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out("doc_id", 3, 1),
        F.coalesce(F.get("languages", F.lit(0)), F.lit("und")).alias("lang_pred"), F.coalesce(F.get("shares", F.lit(0)), F.lit(0.0)).alias("score"), "languages", "shares",
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth, by crc32 of the id, repeat a stretch of words to their end; null ids and null texts stay."""
    hashed = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = (F.col("_h") % 10 == 0) & F.col("text").isNotNull()
    words = F.filter(F.split(F.when(chosen, F.col("text")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    rows = hashed.withColumns({"_w": words, "_g": F.floor(F.col("_h") / 10)})
    rows = rows.withColumns({"_n": F.size("_w"), "_a": (F.col("_g") % F.greatest(F.size("_w"), F.lit(1))).cast("int")})
    rest = F.col("_n") - F.col("_a")
    rows = rows.withColumn("_p", (F.lit(1) + F.floor(rest / (F.lit(3) + F.col("_g") % 8))).cast("int"))
    cycle = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.with_runs(docs)
    # the longest first; ties by the smallest start, then period
    best = F.array_min(F.transform("periodic_runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("periodic_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("periodic_runs").cast("long").alias("n_runs"), best.alias("_b"), listed.alias("_l"), "collapsed_text")
    length, period = -F.col("_b.k"), F.col("_b.period")
    return rows.select(
        "doc_id", "n_runs", F.col("_b.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("_l", 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), noise=199)
    return spelling.variants(words.where("n >= 5")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {q.__name__: q for q in (
    op1_quality_rules, op2_simhash, op3_warc_fixity, op4_packing, op5_lm_scoring, op6_token_attribution, op7_html_extraction, op8_decontamination, op9_quality_classifier, op10_language_id,
    op11_line_dedup, op12_periodic_runs, op13_spelling_variants,
)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_OP8 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(w[i:i + k - 1], ' ') AS p
 FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT x.doc_id, x.i, x.k, p.item FROM x JOIN p USING (k, p)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _levels(replica: str) -> str:
    """Merkle levels of a replica's leaves in SQL."""
    out, below = "", f"{replica}0"
    for level, step in enumerate(("pos // 65536", "pos // 16", "pos // 16", "0"), 1):
        out += f", {replica}{level} AS (SELECT file, up AS pos, sha256(string_agg(pos || ':' || hash, ',' ORDER BY pos)) AS hash FROM (SELECT *, {step} AS up FROM {below}) GROUP BY file, up)"
        below = f"{replica}{level}"
    return out


_OP3 = f"""WITH r AS (SELECT page_id, page_id // 1000 AS file, concat_ws(chr(10), coalesce(url, ''), coalesce(html, '')) AS rec FROM pages),
o AS (SELECT *, strlen(rec) AS n, coalesce(sum(strlen(rec)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r),
a0 AS (SELECT file, pos, n, sha256(rec) AS hash FROM o), b0 AS (SELECT file, pos, n, sha256(CASE WHEN page_id % 97 = 5 THEN rec || 'x' ELSE rec END) AS hash FROM o WHERE page_id % 89 <> 7){_levels('a')}{_levels('b')},
s AS (SELECT file, count(*) AS records, sum(n)::BIGINT AS bytes FROM a0 GROUP BY file),
g AS (SELECT file, count(*) AS k, string_agg(printf('%010d:%s', a0.pos, CASE WHEN b0.hash IS NULL THEN 'missing' ELSE 'corrupt' END), ',' ORDER BY a0.pos) AS l
 FROM a0 LEFT JOIN b0 USING (file, pos) WHERE b0.hash IS DISTINCT FROM a0.hash GROUP BY file)
SELECT CAST(file AS VARCHAR) AS file, records, bytes, a4.hash AS root_a, b4.hash AS root_b, a4.hash IS NOT DISTINCT FROM b4.hash AS intact, coalesce(k, 0) AS n_damaged, coalesce(l, '') AS damaged
FROM a4 JOIN s USING (file) LEFT JOIN b4 USING (file) LEFT JOIN g USING (file)"""

_OP11 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT id) >= 3),
j AS (SELECT k.*, f.key IS NOT NULL AND k.id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY r, doc_id"""

ORACLES: dict[str, str] = {"op3_warc_fixity": _OP3, "op8_decontamination": _OP8, "op11_line_dedup": _OP11}
