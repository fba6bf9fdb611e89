"""A run of all scrapers at once: one plan from pages to a table of decisions.

What a single run does on the driver for one scraper, step by step, is done
here for every scraper by joins and groups: extraction and health of all pages,
repair of the broken ones alone, the proposed strategies' health on the same
pages (shadow), and the gate. No action is taken per scraper; three stages are
written in between, none of which holds html.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import large, stage
from ..operators.extract import extract
from ..operators.health import broken_fields, health
from ..operators.repair import plans, repair, with_proposed
from ..operators.schema import HealthThresholds

ID = "scraper_id"

@dataclass(frozen=True)
class FleetRun:
    """``reports``: a health report per scraper. ``decisions``: what was done about it."""

    reports: DataFrame
    decisions: DataFrame


def run_all(pages: DataFrame, scrapers: DataFrame, golden: DataFrame | None = None, historical: DataFrame | None = None, historical_values: DataFrame | None = None, thresholds: HealthThresholds = HealthThresholds()) -> FleetRun:
    """Run every scraper of ``scrapers`` on its page.

    ``scrapers``: scraper_id, current_version, max_version, strategy (JSON of
    the active version) and expected (null: unknown), one row each. ``pages``:
    scraper_id, url, html, one row each; a scraper without a page, or with a
    null one, extracts no records. Pages of unknown scrapers are left out.
    ``golden``: records to compare with, by scraper_id and pos.

    A decision has scraper_id, old_version, new_version (null unless a version
    is added or nothing changes), action (no_change, promote, shadow, reject),
    reason, confidence, pre_health, post_health, failure_reason,
    candidate_count, selected, field_repairs, strategy (the proposed one) and
    post_status. A version that is promoted is max_version + 1.
    """
    known = scrapers.select(ID, "current_version", "max_version", "strategy", F.col("expected").cast("bigint").alias("expected"))
    work = pages.select(ID, "url", "html").join(large(known.select(ID, "strategy")), ID)
    runs = known.select(ID, "expected")
    records = extract(work, "strategy", [ID]).records
    reports = health(records, [ID], "expected", runs=runs, thresholds=thresholds)
    reports = stage(reports.select("*", broken_fields(thresholds.field_broken).alias("broken_fields")))

    sick = work.join(large(reports.where("status <> 'healthy' AND size(broken_fields) > 0").select(ID, "broken_fields")), ID)
    repairs = repair(sick, [ID], golden=golden, historical=historical, historical_values=historical_values, site=[ID] if golden is not None else None)[0]
    plan = plans(repairs, [ID]).join(large(known.select(ID, "strategy")), ID)
    plan = stage(with_proposed(plan, "strategy").drop("strategy"))

    again = pages.select(ID, "url", "html").join(large(plan.select(ID, F.col("proposed").alias("strategy"))), ID)
    shadow = health(extract(again, "strategy", [ID]).records, [ID], "expected", runs=runs.join(plan.select(ID), ID, "left_semi"), thresholds=thresholds)
    shadow = shadow.select(ID, F.col("health_score").alias("post_health"), F.col("status").alias("post_status"))
    return FleetRun(reports, stage(_decided(reports, known, plan, shadow, thresholds)))


def _decided(reports: DataFrame, known: DataFrame, plan: DataFrame, shadow: DataFrame, thresholds: HealthThresholds) -> DataFrame:
    rows = reports.select(ID, "health_score", "status", "failure_signals").join(large(known.select(ID, "current_version", "max_version")), ID).join(large(plan), ID, "left").join(large(shadow), ID, "left")
    well, planned = F.col("status") == "healthy", F.col("field_repairs").isNotNull()
    passes = F.col("all_promote") & (F.col("post_status") == "healthy") & (F.col("post_health") >= thresholds.healthy)
    action = F.when(well, "no_change").when(~planned, "reject").when(passes, "promote").otherwise("shadow")
    score = F.format_string("%.2f", "post_health")
    reason = (
        F.when(well, F.lit("already healthy")).when(~planned, F.lit("no viable candidates")).when(passes, F.concat(F.lit("shadow health "), score, F.lit(" passes gate")))
        .otherwise(F.concat(F.lit("shadow health "), score, F.lit(f": not promoted (needs >= {thresholds.healthy})")))
    )
    signals = F.array_join("failure_signals", ",")
    # the first field's winner, as fields are sorted
    winner = F.get(F.filter("field_repairs", lambda r: r["value"].isNotNull()), F.lit(0))
    return rows.select(
        ID, F.col("current_version").alias("old_version"),
        F.when(well, F.col("current_version")).when(passes & planned, F.coalesce("max_version", F.lit(0)) + 1).cast("int").alias("new_version"),
        action.alias("action"), reason.alias("reason"), F.when(well, F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.col("health_score").alias("pre_health"), F.when(well, F.col("health_score")).otherwise(F.col("post_health")).alias("post_health"),
        F.when(~well, F.when(signals == "", "unknown").otherwise(signals)).alias("failure_reason"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.when(passes & planned, F.to_json(winner)).alias("selected"), "field_repairs", F.when(planned, F.col("proposed")).alias("strategy"), "post_status",
    )
