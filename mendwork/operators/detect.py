"""Degradation of a run against a baseline run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import FIELDS

#: what a baseline report is asked for
_BASELINE = {"health_score": "double", "records_received": "bigint", "null_rates": "map<string,double>", "fingerprint": "string"}


def _broken(rates: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(rates, lambda _, r: r >= 0.5)))


def detect(current: DataFrame, baseline: DataFrame | None, keys: list[str], on: list[str] | None = None, healthy: float = 0.90, critical_drop: float = 0.20, warning_drop: float = 0.05, critical_spike: float = 0.40) -> DataFrame:
    """One detection report per health report in ``current``.

    ``baseline`` holds health reports joined on the columns ``on`` (one row per
    value; an empty list joins a single baseline to all). Both may have a
    column ``fingerprint``; a changed fingerprint alone never raises an alarm.
    Without a baseline row, deltas are the current rates and drops are zero.
    """
    rows = current
    if baseline is None:
        rows = rows.withColumns({f"_b_{c}": F.lit(None).cast(t) for c, t in _BASELINE.items()})
    else:
        own = baseline.select(*(on or []), *[F.col(c).alias(f"_b_{c}") for c in ("health_score", "records_received", "null_rates")], (F.col("fingerprint") if "fingerprint" in baseline.columns else F.lit(None).cast("string")).alias("_b_fingerprint"))
        rows = rows.join(own, on, "left") if on else rows.join(own, F.lit(True), "left")
    return _detected(rows, keys, healthy, critical_drop, warning_drop, critical_spike)


def _detected(rows: DataFrame, keys: list[str], healthy: float, critical_drop: float, warning_drop: float, critical_spike: float) -> DataFrame:
    """Detection reports of rows that have their baseline beside them, in ``_b_`` columns."""
    prints = "fingerprint" in rows.columns
    there = F.col("_b_health_score").isNotNull()
    score = F.col("health_score")
    now, before = _broken(F.col("null_rates")), F.when(there, _broken(F.col("_b_null_rates"))).otherwise(F.array().cast("array<string>"))
    rate = lambda m, f: F.coalesce(F.element_at(m, f), F.lit(0.0))
    deltas = {f: F.bround(rate(F.col("null_rates"), f) - rate(F.col("_b_null_rates"), f), 4) for f in FIELDS}
    moved = F.when(there, score - F.col("_b_health_score")).otherwise(F.lit(0.0))
    print_now = F.col("fingerprint") if prints else F.lit(None).cast("string")
    changed = F.coalesce((F.col("_b_fingerprint") != "") & (print_now != "") & (F.col("_b_fingerprint") != print_now), F.lit(False))
    rows = rows.withColumns({"_delta": moved, "_spike": F.greatest(*deltas.values()), "_changed": changed, "_now": now, "_before": before})
    new, recovered = F.array_sort(F.array_except("_now", "_before")), F.when(there, F.array_sort(F.array_except("_before", "_now"))).otherwise(F.array().cast("array<string>"))
    drop = -F.col("_delta")
    pct = lambda x: F.format_string("%.2f", x)
    given = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    critical = given([
        F.when(F.col("status") == "repair_required", "absolute_status_repair_required"),
        F.when(F.col("records_received") == 0, "no_records_extracted"),
        F.when(there & (drop >= critical_drop), F.concat(F.lit("health_drop:"), pct(drop), F.lit(f">={critical_drop}"))),
        F.when(there & (F.col("_spike") >= critical_spike), F.concat(F.lit("null_spike:"), pct(F.col("_spike")), F.lit(f">={critical_spike}"))),
    ])
    odd = F.filter("failure_signals", lambda s: s.startswith("identical_") | s.startswith("null_spike:") | s.startswith("type_drift"))
    warning = F.concat(
        given([F.when(F.col("status") == "warning", "absolute_status_warning"), F.when(there & (drop >= warning_drop), F.concat(F.lit("health_drop:"), pct(drop), F.lit(f">={warning_drop}")))]),
        F.transform(odd, lambda s: F.concat(F.lit("anomaly:"), s)),
    )
    rows = rows.withColumns({"_critical": critical, "_warning": warning})
    severity = F.when(F.size("_critical") > 0, "critical").when(F.size("_warning") > 0, "warning").otherwise("none")
    confidence = (
        F.when(F.size("_critical") > 0, F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.1) * F.size("_critical") + F.greatest(F.lit(0.0), F.lit(healthy) - score)))
        .when(F.size("_warning") > 0, F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.1) * F.size("_warning")))
        .when(F.col("status") == "healthy", F.lit(1.0))
        .otherwise(F.lit(0.8))
    )
    plain = F.concat(F.lit("health="), pct(score), F.lit(" ("), F.col("status"), F.lit(")"))
    summary = (
        F.when(F.size(new) > 0, F.concat(plain, F.lit("; newly broken: "), F.array_join(new, ", ")))
        .when(F.col("records_received") == 0, F.lit("no records extracted"))
        .otherwise(F.concat_ws("; ", F.when(there, F.concat(F.lit("health "), pct(F.col("_b_health_score")), F.lit("→"), pct(score))).otherwise(plain), F.when(F.size("failure_signals") > 0, F.concat(F.lit("signals: "), F.array_join(F.slice("failure_signals", 1, 3), ", ")))))
    )
    quiet = F.when(F.col("_changed"), F.lit("DOM fingerprint changed but extracted data is unchanged — cosmetic redesign")).otherwise(F.lit("extraction healthy"))
    return rows.select(
        *keys,
        (severity != "none").alias("detected"),
        severity.alias("severity"),
        F.bround(confidence, 4).alias("confidence"),
        F.when(severity == "none", quiet).otherwise(summary).alias("reason"),
        F.col("failure_signals").alias("signals"),
        F.when(F.size("_critical") > 0, F.col("_critical")).otherwise(F.col("_warning")).alias("triggering_rules"),
        F.struct(
            F.col("_b_health_score").alias("baseline_health"), score.alias("current_health"), F.col("_delta").alias("health_delta"),
            F.col("_b_records_received").alias("baseline_record_count"), F.col("records_received").alias("current_record_count"),
            F.when(there, F.col("records_received") - F.col("_b_records_received")).otherwise(0).alias("record_count_delta"),
            F.col("_changed").alias("fingerprint_changed"), F.create_map(*[x for f in FIELDS for x in (F.lit(f), deltas[f])]).alias("null_rate_deltas"),
            F.col("_now").alias("fields_broken_now"), F.col("_before").alias("fields_broken_baseline"), new.alias("newly_broken_fields"), recovered.alias("recovered_fields"),
        ).alias("evidence"),
    )


def accuracy(rows: DataFrame, detected: str = "detected", truth: str = "truth") -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy; 0 where a denominator is 0."""
    d, t = F.col(detected), F.col(truth)
    counts = rows.agg(F.count_if(d & t).alias("tp"), F.count_if(~d & ~t).alias("tn"), F.count_if(d & ~t).alias("fp"), F.count_if(~d & t).alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = part(tp, tp + fp), part(tp, tp + fn)
    return counts.select("tp", "tn", "fp", "fn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(part(2 * p * r, p + r), 4).alias("f1"), F.bround(part(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"))



def baseline_as_of(reports: DataFrame, keys: list[str], order: str = "run", span: int = 65_536) -> DataFrame:
    """Append ``baseline``: what the latest healthy run before each run reported, as a struct; null if there is none.

    ``reports`` has a row per run; ``order`` is an integer that no two runs of
    a scraper (``keys``) share. A history is cut into chunks of ``span`` orders.
    A run looks back within its chunk by a window, and beyond it at the last
    good report of the chunks before, of which there is a row each; so a task
    sorts one chunk, however long the history of a single scraper is.
    """
    held = [c for c in _BASELINE if c in reports.columns]
    good = F.when(F.col("status") == "healthy", F.struct(order, *held))
    rows = reports.withColumn("_chunk", F.floor(F.col(order) / span))
    own = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by(good, F.when(good.isNotNull(), F.col(order))).alias("_good"))
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "_chunk", F.last("_good", ignorenulls=True).over(past).alias("_before"))
    found = rows.withColumn("_own", F.last(good, ignorenulls=True).over(own)).join(before, [*keys, "_chunk"], "left")
    return found.withColumn("baseline", F.coalesce("_own", "_before")).drop("_own", "_before", "_chunk")


def detect_as_of(reports: DataFrame, keys: list[str], order: str = "run", span: int = 65_536, healthy: float = 0.90, critical_drop: float = 0.20, warning_drop: float = 0.05, critical_spike: float = 0.40) -> DataFrame:
    """A detection report for every run, by ``keys`` and ``order``, against the latest healthy run before it."""
    rows = baseline_as_of(reports, keys, order, span)
    there = {f.name for f in rows.schema["baseline"].dataType}
    rows = rows.withColumns({f"_b_{c}": F.col(f"baseline.{c}") if c in there else F.lit(None).cast(t) for c, t in _BASELINE.items()})
    return _detected(rows, [*keys, order], healthy, critical_drop, warning_drop, critical_spike)
