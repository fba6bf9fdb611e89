"""State of scrapers as append-only Parquet tables.

Nothing is updated in place: scrapers are events, of which the last one of
each scraper wins; versions, runs and repair events are appended. A single
writer is assumed, as version numbers are the maximum plus one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "scrapers": "seq bigint, id bigint, name string, target_url string, schema_fields array<string>, current_version int, health_score double, status string, created_at double, updated_at double",
    "versions": "scraper_id bigint, version int, strategy string, reason string, confidence double, created_at double",
    "runs": "id bigint, scraper_id bigint, version int, records_expected bigint, records_received bigint, health_score double, status string, signals array<string>, full_report string, timestamp double",
    "repair_events": "id bigint, scraper_id bigint, old_version int, new_version int, failure_reason string, candidate_count int, selected_candidate string, confidence double, plan string, action string, timestamp double",
}


def current(events: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last event of each key."""
    names = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_s")).select(key, *[F.col("_s")[c].alias(c) for c in names])


def latest(rows: DataFrame, n: int, order: str = "timestamp", per: str | None = None) -> DataFrame:
    """The last ``n`` rows by time, newest first; with ``per``, of each key."""
    if per is None:
        return rows.orderBy(F.desc(order), F.desc("id")).limit(n)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(order), F.desc("id")))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        for name in SCHEMAS:
            self._append(name, [])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def _append(self, name: str, rows: list[tuple], mode: str = "append") -> None:
        self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode(mode).parquet(f"{self.root}/{name}")

    def reset(self) -> None:
        for name in SCHEMAS:
            self._append(name, [], "overwrite")

    def _next(self, name: str, column: str) -> int:
        return int(self.table(name).agg(F.coalesce(F.max(column), F.lit(0))).first()[0]) + 1

    def scrapers(self) -> DataFrame:
        return current(self.table("scrapers")).orderBy("id")

    def scraper(self, scraper_id: int):
        return current(self.table("scrapers").where(F.col("id") == scraper_id)).first()

    def _event(self, **state) -> None:
        order = ("id", "name", "target_url", "schema_fields", "current_version", "health_score", "status", "created_at", "updated_at")
        self._append("scrapers", [(self._next("scrapers", "seq"), *[state[k] for k in order])])

    def upsert(self, name: str, target_url: str, fields: list[str]) -> int:
        found = current(self.table("scrapers").where(F.col("name") == name)).first()
        now = time.time()
        if found:
            self._event(**found.asDict() | {"target_url": target_url, "schema_fields": fields, "updated_at": now})
            return found.id
        new = self._next("scrapers", "id")
        self._event(id=new, name=name, target_url=target_url, schema_fields=fields, current_version=1, health_score=0.0, status="unknown", created_at=now, updated_at=now)
        return new

    def update(self, scraper_id: int, **changes) -> None:
        """Set current_version, or health_score and status."""
        self._event(**self.scraper(scraper_id).asDict() | changes | {"updated_at": time.time()})

    def add_version(self, scraper_id: int, strategy: str, reason: str, confidence: float) -> int:
        own = self.table("versions").where(F.col("scraper_id") == scraper_id)
        version = int(own.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) + 1
        self._append("versions", [(scraper_id, version, strategy, reason, float(confidence), time.time())])
        return version

    def versions(self, scraper_id: int) -> DataFrame:
        return self.table("versions").where(F.col("scraper_id") == scraper_id).orderBy("version")

    def version(self, scraper_id: int, version: int) -> str | None:
        row = self.table("versions").where((F.col("scraper_id") == scraper_id) & (F.col("version") == version)).first()
        return row and row.strategy

    def record_run(self, scraper_id: int, version: int, report, full_report: str) -> None:
        self._append("runs", [(self._next("runs", "id"), scraper_id, version, report.records_expected, report.records_received, report.health_score, report.status, report.failure_signals, full_report, time.time())])

    def record_repair(self, scraper_id: int, old: int, new: int | None, why: str, count: int, selected: str | None, confidence: float, plan: str, action: str) -> None:
        self._append("repair_events", [(self._next("repair_events", "id"), scraper_id, old, new, why, count, selected, float(confidence), plan, action, time.time())])

    def runs(self, scraper_id: int | None = None, n: int = 50) -> DataFrame:
        rows = self.table("runs")
        return latest(rows if scraper_id is None else rows.where(F.col("scraper_id") == scraper_id), n)

    def repair_events(self, scraper_id: int | None = None, n: int = 50) -> DataFrame:
        rows = self.table("repair_events")
        return latest(rows if scraper_id is None else rows.where(F.col("scraper_id") == scraper_id), n)

    def repair_event(self, event_id: int):
        return self.table("repair_events").where(F.col("id") == event_id).first()
