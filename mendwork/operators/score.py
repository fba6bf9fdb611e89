"""Scores of candidate selectors from the records that they would give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import large
from .dedupe import present
from .schema import FIELDS, ID

WEIGHTS = {"schema_validity": 0.25, "completeness": 0.25, "type_validity": 0.20, "similarity": 0.15, "historical_consistency": 0.15}

# Gate thresholds
MIN_ACCEPT, SHADOW, PROMOTE, MIN_COMPLETENESS, MIN_SCHEMA, TOP_K = 0.60, 0.75, 0.90, 0.80, 0.80, 5


def _by_field(make) -> Column:
    """``make(field)`` for the row's ``field``; null for fields beyond the schema."""
    return F.coalesce(*[F.when(F.col("field") == f, make(f)) for f in FIELDS])


def _plausible(f: str) -> Column:
    v = F.col(f)
    ok = {
        "price": v > 0, "rating": (v >= 0) & (v <= 5), "review_count": v >= 0, "currency": v.rlike("^[A-Z]{3}$"),
        "product_url": v.rlike("^https?://"), "image_url": v.rlike("^https?://"),
    }.get(f, F.lit(True)) if f != ID else F.lit(True)
    return F.coalesce(v.isNotNull() & (v.cast("string") != "") & ok, F.lit(False))


def shown(f: str, record: str = "") -> Column:
    """A value as text, from its own column or as a loose value; numbers of one type compare alike."""
    loose, own = F.col(f"{record}loose"), F.col(f"{record}{f}")
    return F.coalesce(own.cast("string"), F.element_at(loose, f))


def field_scores(records: DataFrame, groups: list[str], golden: DataFrame | None = None, historical: DataFrame | None = None, site: list[str] | None = None) -> DataFrame:
    """Five components and their total per group and field.

    ``records``: records under a candidate, with its ``field`` and consecutive
    places ``pos`` in each group. ``golden``: records by ``pos`` (and the
    ``site`` columns, which are among the groups) to compare with; without it,
    similarity is how even the values' lengths are.
    ``historical`` (field, value as text, and any of the groups): former values
    of those groups; without any for a field, consistency is 0.5. Components and total are rounded to 4 places,
    the total from the unrounded ones.
    """
    value, typed = _by_field(shown), _by_field(lambda f: F.col(f).isNotNull() & ~F.coalesce(F.map_contains_key("loose", f), F.lit(False)))
    rows = records.select(*groups, "field", "pos", value.alias("_v"), _by_field(_plausible).alias("_ok"), _by_field(present).alias("_there"), typed.alias("_typed"))
    length = F.length(_python_text("_v"))
    aggregates = [
        F.count("*").alias("_n"),
        *[F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), F.lit(0.0)).alias(a) for c, a in (("_ok", "schema_validity"), ("_there", "completeness"), ("_typed", "type_validity"))],
    ]
    if golden is not None:
        by = [*(site or []), "pos"]
        want = golden.select(*by, *[shown(f).alias(f"_g_{f}") for f in FIELDS], F.lit(True).alias("_known"))
        rows = rows.join(large(want), by, "left").withColumn("_known", F.when(F.col("field").isin(*FIELDS), F.col("_known")))
        # fields beyond the schema are null on both sides
        hit = F.col("_v").eqNullSafe(_by_field(lambda f: F.col(f"_g_{f}"))).cast("int")
        aggregates.append(F.coalesce(F.sum(F.when(F.col("_known"), hit)) / F.count("_known"), F.lit(0.0)).alias("similarity"))
    else:
        mean = F.avg(length)
        aggregates.append(F.when((F.count("_v") == 0) | (mean == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_pop(length) / F.greatest(mean, F.lit(1.0))))).alias("similarity"))
    if historical is not None:
        by = [*[g for g in groups if g in historical.columns], "field"]
        past = historical.where("value IS NOT NULL")
        bag = past.groupBy(*by).agg(F.count("*").alias("_bag"))
        seen = past.select(*by, F.col("value").alias("_v"), F.lit(1).alias("_seen")).distinct()
        rows = rows.join(large(seen), [*by, "_v"], "left").join(bag, by, "left")
        aggregates.append(F.when(F.max("_bag") > 0, F.avg(F.coalesce("_seen", F.lit(0)))).otherwise(0.5).alias("historical_consistency"))
    else:
        aggregates.append(F.lit(0.5).alias("historical_consistency"))
    parts = rows.groupBy(*groups, "field").agg(*aggregates)
    total = sum((F.lit(w) * F.col(c) for c, w in list(WEIGHTS.items())[1:]), F.lit(WEIGHTS["schema_validity"]) * F.col("schema_validity"))
    return parts.withColumn("_total", total).select(*groups, "field", *[F.bround(c, 4).alias(c) for c in WEIGHTS], F.bround("_total", 4).alias("total"))


def _python_text(v: str) -> Column:
    """Whole doubles print with .0 and without an exponent."""
    x = F.col(v)
    return F.when(x.rlike(r"^-?\d+(\.\d+)?E\d+$"), F.concat(x.cast("double").cast("bigint").cast("string"), F.lit(".0"))).otherwise(x)


def strategy_score(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Mean of the rounded components over a group's fields."""
    return scores.groupBy(*groups).agg(*[F.bround(F.avg(c), 4).alias(c) for c in (*WEIGHTS, "total")])


def rank(scores: DataFrame, groups: list[str], order: str = "gen_ord") -> DataFrame:
    """Append ``rank``: by the rounded total, ties in the order of generation."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*groups, "field").orderBy(F.desc("total"), order)))


def gate(total: str = "total", completeness: str = "completeness", schema: str = "schema_validity") -> tuple[Column, Column]:
    """(action, reason) for a winner: promote, shadow or reject."""
    t, c, s = F.col(total), F.col(completeness), F.col(schema)
    best, fair, some = (t >= PROMOTE) & (c >= MIN_COMPLETENESS) & (s >= MIN_SCHEMA), (t >= SHADOW) & (c >= MIN_COMPLETENESS), t >= MIN_ACCEPT
    text = lambda form: F.format_string(form, t)
    action = F.when(best, "promote").when(fair | some, "shadow").otherwise("reject")
    reason = (
        F.when(t.isNull(), F.lit("no candidates could be generated"))
        .when(best, text(f"score %.2f >= promote threshold {PROMOTE}"))
        .when(fair, text(f"score %.2f >= shadow threshold {SHADOW}, below promote threshold {PROMOTE}"))
        .when(some, text("marginal candidate (score %.2f); staying in shadow"))
        .otherwise(text("best candidate score %.2f < min_accept " + f"{MIN_ACCEPT:.1f}"))
    )
    return action, reason


def field_accuracy(records: DataFrame, golden: DataFrame, groups: list[str], site: list[str] | None = None) -> DataFrame:
    """Share of equal values over the places (of a site) that both have, all required fields."""
    a, b = records.alias("a"), large(golden).alias("b")
    both = a.join(b, reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("pos", *(site or []))]))
    hits = sum((shown(f, "a.").eqNullSafe(shown(f, "b.")).cast("int") for f in FIELDS), F.lit(0))
    return both.groupBy(*[F.col(f"a.{g}").alias(g) for g in groups]).agg((F.sum(hits) / (F.count("*") * len(FIELDS))).alias("field_accuracy"))


def with_hits(records: DataFrame, golden: DataFrame, site: list[str] | None = None) -> tuple[DataFrame, Column]:
    """(records with what golden has at their places, the aggregate that ``field_accuracy`` gives, null without such places)."""
    by = [*(site or []), "pos"]
    want = golden.groupBy(*[F.col(c).alias(f"_at_{c}") for c in by]).agg(F.collect_list(F.struct(*[shown(f).alias(f) for f in FIELDS])).alias("_want"))
    both = records.join(large(want), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in by]), "left").drop(*[f"_at_{c}" for c in by])
    equal = lambda g: sum((shown(f).eqNullSafe(g[f]).cast("int") for f in FIELDS), F.lit(0))
    hits, places = F.aggregate("_want", F.lit(0), lambda n, g: n + equal(g)), F.when(F.col("_want").isNotNull(), F.size("_want"))
    return both, F.try_divide(F.sum(hits), F.sum(places) * len(FIELDS)).alias("field_accuracy")
