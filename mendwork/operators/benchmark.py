"""Quality benchmark: extraction with and without healing over controlled breakage."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import large, stage
from .detect import accuracy, detect
from .extract import extract
from .health import broken_fields, health
from .repair import plans, repair, with_proposed
from .schema import Strategy, default_strategy
from .score import with_hits


def whole_site(records: DataFrame, groups: list[str]) -> DataFrame:
    """Records of a site's pages as one sequence of places."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("page_no", "pos")) - 1
    return records.withColumn("pos", place.cast("int"))


def rows_of(pages: DataFrame, strategy: Strategy | str, golden: DataFrame, expected: int, groups: list[str], site: list[str]) -> tuple[DataFrame, DataFrame]:
    """(benchmark rows by group, health reports)."""
    # one pass over the pages: health and accuracy are aggregates of the same records
    records, right = with_hits(whole_site(extract(pages, strategy, [*groups, "page_no"]).records, groups), golden, site)
    report = stage(health(records, groups, expected, runs=pages.select(*groups).distinct(), more=[right]))
    accuracy_ = F.bround(F.coalesce("field_accuracy", F.lit(0.0)), 4).alias("field_accuracy")
    return report.select(*groups, F.col("records_received").alias("records"), "completeness", "validity", accuracy_, F.col("health_score").alias("health"), "status"), report.drop("field_accuracy")


def run(pages: DataFrame, golden: DataFrame, expected: int, strategy: Strategy | None = None, site: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, summary by system, plans of repair).

    ``pages`` has the layout, page_no, url and html of one site, or of many
    with the ``site`` columns, which ``golden`` then has too. The first page of
    each unhealthy site and layout is what repair sees; it is extracted again
    if all its broken fields promote. mttr_ms is the wall time of the repair
    job over the number of its plans.
    """
    strategy, site = strategy or default_strategy(), site or []
    groups = [*site, "layout"]
    plain, report = rows_of(pages, strategy, golden, expected, groups, site)
    sick = report.where("status != 'healthy'").select(*groups, broken_fields().alias("broken_fields"))
    first = pages.where("page_no = 1").join(large(sick), groups).withColumn("strategy", F.lit(strategy.to_json()))
    began = time.time()
    repairs = repair(first, groups, golden=golden, site=site)[0]
    plan = stage(with_proposed(plans(repairs, groups).withColumn("_old", F.lit(strategy.to_json())), "_old").drop("_old"))
    each = (time.time() - began) * 1000 / max(1, plan.count())
    fixed = plan.where("all_promote").select(*groups, F.col("proposed").alias("strategy"))
    healed = rows_of(pages.join(large(fixed), groups), "strategy", golden, expected, groups, site)[0]
    healed = plain.join(large(fixed), groups, "left_anti").unionByName(healed)
    tried = plan.select(*groups, F.lit(True).alias("repair_attempted"), F.col("confidence").alias("repair_confidence"), F.lit(each).alias("mttr_ms"))
    none = {"repair_attempted": F.lit(False), "repair_confidence": F.lit(0.0), "mttr_ms": F.lit(0.0)}
    before = plain.withColumn("system", F.lit("baseline")).withColumns(none)
    after = healed.join(large(tried), groups, "left").fillna({"repair_attempted": False, "repair_confidence": 0.0, "mttr_ms": 0.0}).withColumn("system", F.lit("healing"))
    rows = before.unionByName(after)
    return rows, summary(rows, groups), plan


def summary(rows: DataFrame, groups: list[str] | None = None, baseline: str = "baseline") -> DataFrame:
    """Runs, averages, repairs and their times by system; broken are the groups that are unhealthy in the baseline."""
    groups = groups or ["layout"]
    broken = rows.where((F.col("system") == baseline) & (F.col("status") != "healthy")).select(*groups).distinct().withColumn("_broken", F.lit(True))
    marked = rows.join(large(broken), groups, "left").fillna(False, subset=["_broken"])
    tried = F.col("repair_attempted") & F.col("_broken")
    fixed = tried & (F.col("status") == "healthy")
    return marked.groupBy("system").agg(
        F.count("*").alias("runs"),
        F.bround(F.avg("field_accuracy"), 4).alias("avg_field_accuracy"),
        F.bround(F.avg("completeness"), 4).alias("avg_completeness"),
        F.count_if(F.col("status") == "healthy").alias("healthy_runs"),
        F.count_if(tried).alias("repair_attempts"),
        F.count_if(fixed).alias("repair_successes"),
        F.bround(F.coalesce(F.try_divide(F.count_if(fixed), F.count_if(tried)), F.lit(0.0)), 4).alias("repair_rate"),
        F.count_if(F.col("repair_attempted") & ~F.col("_broken")).alias("false_repairs"),
        F.bround(F.coalesce(F.avg(F.when(tried, F.col("mttr_ms"))), F.lit(0.0)), 2).alias("mttr_ms"),
    )


def detection(pages: DataFrame, expected: int, truth: dict[str, bool], baseline: str, strategy: Strategy | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports by layout, accuracy) of the detector against labels."""
    got = extract(pages, strategy or default_strategy(), ["layout", "page_no"])
    report = health(whole_site(got.records, ["layout"]), ["layout"], expected, runs=pages.select("layout").distinct())
    prints = got.pages.join(pages.select("layout", "page_no"), ["layout", "page_no"]).where("page_no = 1").select("layout", "fingerprint")
    report = report.join(prints, "layout", "left")
    found = detect(report, report.where(F.col("layout") == baseline), ["layout"])
    labels = pages.sparkSession.createDataFrame(list(truth.items()), "layout string, truth boolean")
    return found, accuracy(found.join(labels, "layout"))


def markdown(rows: list, summaries: list) -> str:
    """The two tables as Markdown text, from collected rows."""
    def text(items, columns):
        lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
        return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in items])

    return text(summaries, summaries[0].__fields__) + "\n\n" + text(rows, rows[0].__fields__) + "\n"
