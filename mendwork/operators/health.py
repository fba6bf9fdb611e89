"""Run health: one aggregation of a run's records, with partial sums in every task.

A run is a group of ``keys``. All counts, by field and by code too, come from
one groupBy without exploding violations; the report's scores, status and
signals are expressions over those counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memo import memo
from ..functions.normalize import float_text
from .dedupe import filled, present
from .rules import Rule, default_rules, violations
from .schema import FIELDS, HealthThresholds, HealthWeights


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def _quoted(x: Column) -> Column:
    """A text in single quotes, or in double ones if only those are free."""
    free = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
    return F.when(free, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _positive(names: Sequence[str], prefix: str) -> Column:
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"{prefix}{n}").alias("value")) for n in names])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def health(
    records: DataFrame,
    keys: Sequence[str],
    expected: int | str | None = None,
    runs: DataFrame | None = None,
    baseline_null_rates: str | None = None,
    weights: HealthWeights = HealthWeights(),
    thresholds: HealthThresholds = HealthThresholds(),
    rules: Sequence[Rule] | None = None,
    more: Sequence[Column] = (),
) -> DataFrame:
    """One health report per run.

    ``expected``: a number for all runs, or a column. ``runs``: a frame with
    the keys of all runs and the columns that ``expected`` and
    ``baseline_null_rates`` name; a run without records is reported only if it
    is there. Ratios are rounded to 4 places (half even), the status comes from
    the unrounded score. ``more``: further aggregates of a run's records, by
    their names in the report.
    """
    checks = tuple((c.field, c.code) for r in (default_rules() if rules is None else rules) for c in r.checks)
    keys = list(keys)
    per_run = isinstance(expected, str) and runs is None
    rows = records.withColumn("_v", violations(rules))
    sums = rows.groupBy(*keys).agg(*_counts(checks), *more, *([F.max(expected).alias(expected)] if per_run and expected not in keys else []))
    if runs is not None:
        sums = runs.join(sums, keys, "left")
        numbers = [c for c in sums.columns if c == "received" or c.startswith(("_code_", "_field_", "_null_")) or c in ("_filled", "_valid", "_given", "_price_n", "_url_n", "_name_n")]
        sums = sums.fillna(0, subset=numbers)
    own = rows.groupBy().agg(*more).columns if more else []
    unrounded, columns = _report(checks, expected, baseline_null_rates, weights, thresholds)
    return sums.select("*", *unrounded[0]).select("*", unrounded[1]).select(*keys, *columns, *own)


@memo
def _counts(checks: tuple[tuple[str, str], ...]) -> list[Column]:
    """Aggregates of a run's records with their violations ``_v``."""
    codes, fields = list(dict.fromkeys(c for _, c in checks)), list(dict.fromkeys(f for f, _ in checks))
    count = lambda part, value: F.sum(F.size(F.filter("_v", lambda v: v[part] == value))).cast("bigint")

    def first(f: str) -> Column:
        own = F.filter("_v", lambda v: v["field"] == f)
        return F.min(F.when(F.size(own) > 0, F.struct("pos", F.element_at(own, 1)["ord"].alias("ord"))))

    given = [F.when(F.col(f).isNotNull() | F.coalesce(F.map_contains_key("loose", f), F.lit(False)), 1).otherwise(0) for f in FIELDS]
    same = lambda x, n: [F.count(x).alias(f"_{n}_n"), F.min(x).alias(f"_{n}_lo"), F.max(x).alias(f"_{n}_hi")]
    text = lambda f: F.when(F.col(f) != "", F.col(f))
    return [
        F.count("*").alias("received"),
        F.sum(filled()).alias("_filled"),
        F.count_if(F.size("_v") == 0).alias("_valid"),
        F.sum(reduce(Column.__add__, given)).alias("_given"),
        *[count("code", c).alias(f"_code_{c}") for c in codes],
        *[count("field", f).alias(f"_field_{f}") for f in fields],
        *[first(f).alias(f"_first_{f}") for f in fields],
        *[F.count_if(~present(f)).alias(f"_null_{f}") for f in FIELDS],
        *same(F.col("price"), "price"), *same(text("product_url"), "url"), *same(text("product_name"), "name"),
    ]


@memo
def _report(checks: tuple[tuple[str, str], ...], expected: int | str | None, baseline_null_rates: str | None, weights: HealthWeights, thresholds: HealthThresholds):
    """The unrounded ratios, the score from them, and the report's columns from both."""
    codes, fields = list(dict.fromkeys(c for _, c in checks)), list(dict.fromkeys(f for f, _ in checks))
    n = F.col("received")
    e = F.col(expected) if isinstance(expected, str) else F.lit(expected).cast("bigint")
    completeness = F.least(F.lit(1.0), F.col("_filled") / F.greatest(F.lit(1), n * len(FIELDS)))
    validity = F.col("_valid") / F.greatest(F.lit(1), n)
    wrong = F.col("_code_wrong_type") if "wrong_type" in codes else F.lit(0)
    consistent = F.when(F.col("_given") == 0, F.lit(1.0)).otherwise(1.0 - wrong / F.col("_given"))
    steady = F.when(e.isNull() | (e == 0), (n > 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(n - e) / e))
    ratios = [completeness.alias("_c"), validity.alias("_vd"), consistent.alias("_s"), steady.alias("_r")]
    score = F.lit(weights.completeness) * F.col("_c") + F.lit(weights.validity) * F.col("_vd") + F.lit(weights.schema_consistency) * F.col("_s") + F.lit(weights.record_consistency) * F.col("_r")
    rates = {f: F.when(n > 0, F.col(f"_null_{f}") / n).otherwise(F.lit(1.0)) for f in FIELDS}
    broken = F.array_min(F.filter(F.array(*[F.when((n > 0) & (F.col(f"_field_{f}") / n >= thresholds.field_broken), F.struct((-F.col(f"_field_{f}")).alias("k"), F.col(f"_first_{f}").alias("at"), F.lit(f).alias("f"))) for f in fields]), lambda x: x.isNotNull()))
    pct = lambda x: F.format_string("%.2f", x)
    signals = [
        F.when(n == 0, F.lit("no_records_extracted")),
        F.when((e > 0) & (n < e * thresholds.record_collapse), F.format_string("record_count_collapse:%d/%d", n, e)),
        F.when(F.col("_c") < thresholds.low_completeness, F.concat(F.lit("low_completeness:"), pct(F.col("_c")))),
        F.when(broken.isNotNull(), F.concat(F.lit("field_widely_broken:"), broken["f"], F.lit("="), pct(-broken["k"] / n))),
        F.when(wrong > 0, F.format_string("type_drift:%d", wrong)),
    ]
    if baseline_null_rates:
        base = F.col(baseline_null_rates)
        for f in FIELDS:
            before = F.coalesce(F.element_at(base, f), F.lit(0.0))
            signals.append(F.when((F.size(base) > 0) & (rates[f] - before > thresholds.null_spike), F.concat(F.lit(f"null_spike:{f}="), pct(before), F.lit("->"), pct(rates[f]))))
    alike = lambda x: (n >= 2) & (F.col(f"_{x}_n") >= 3) & (F.col(f"_{x}_lo") == F.col(f"_{x}_hi"))
    signals += [
        F.when(alike("price"), F.concat(F.lit("identical_prices:"), float_text(F.col("_price_lo")))),
        F.when(alike("url"), F.lit("identical_product_urls")),
        F.when(alike("name"), F.concat(F.lit("identical_product_names:"), _quoted(F.col("_name_lo")))),
    ]
    status = F.when(F.col("_score") >= thresholds.healthy, "healthy").when(F.col("_score") >= thresholds.warning, "warning").otherwise("repair_required")
    columns = [
        e.alias("records_expected"),
        n.alias("records_received"),
        *[F.bround(c, 4).alias(a) for c, a in (("_c", "completeness"), ("_vd", "validity"), ("_s", "schema_consistency"), ("_r", "record_consistency"), ("_score", "health_score"))],
        status.alias("status"),
        _positive(fields, "_field_").alias("violations_by_field"),
        _positive(codes, "_code_").alias("violations_by_code"),
        F.filter(F.array(*signals), lambda x: x.isNotNull()).alias("failure_signals"),
        F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.bround(rates[f], 4))]).alias("null_rates"),
        F.col("_filled").cast("bigint").alias("filled_cells"),
        F.col("_valid").cast("bigint").alias("valid_records"),
        F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"_null_{f}").cast("bigint"))]).alias("null_counts"),
        F.create_map(*[x for k, v in weights.__dict__.items() for x in (F.lit(k), F.lit(v))]).alias("weights"),
        F.create_map(*[x for k, v in thresholds.__dict__.items() for x in (F.lit(k), F.lit(v))]).alias("thresholds"),
    ]
    return (ratios, score.alias("_score")), columns


def broken_fields(share: float = 0.8) -> Column:
    """Fields of a health report with violations in at least ``share`` of the records, sorted."""
    n = F.greatest(F.lit(1), F.col("records_received"))
    return F.array_sort(F.map_keys(F.map_filter("violations_by_field", lambda _, c: c / n >= share)))
