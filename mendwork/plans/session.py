"""The control surface: register scrapers, run them, look at history, roll back."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candidates import CandidateProvider, propose_with
from ..operators.extract import extract
from ..operators.health import broken_fields, health
from ..operators.repair import plans, proposed, repair
from ..operators.schema import HealthThresholds, Strategy, default_strategy
from ..sources.pages import Settings, Source
from ..sources.store import Store


#: records that a run expects if nothing else is said
RECORDS_EXPECTED = 20


@dataclass(frozen=True)
class Decision:
    """What a run did: no_change, promote, shadow, reject or rollback."""

    scraper_id: int
    old_version: int
    new_version: int | None
    action: str
    reason: str
    confidence: float
    pre_health: float
    post_health: float | None


class Session:
    def __init__(self, spark: SparkSession, root: str, source: Source, settings: Settings = Settings(), provider: CandidateProvider | None = None) -> None:
        self.spark, self.store, self.source, self.settings, self.provider = spark, Store(spark, root), source, settings, provider
        self.thresholds = HealthThresholds(healthy=settings.healthy_threshold, warning=settings.warning_threshold)

    def register(self, name: str, target_url: str, strategy: Strategy | None = None, reason: str = "initial registration") -> int:
        strategy = strategy or default_strategy()
        scraper = self.store.upsert(name, target_url, list(strategy.fields))
        if self.store.versions(scraper).isEmpty():
            self.store.add_version(scraper, strategy.to_json(), reason, 1.0)
            self.store.update(scraper, current_version=1)
        return scraper

    def scraper(self, scraper_id: int):
        found = self.store.scraper(scraper_id)
        if found is None:
            raise LookupError(f"scraper {scraper_id} is not registered")
        return found

    def active_strategy(self, scraper_id: int) -> Strategy:
        version = self.scraper(scraper_id).current_version
        text = self.store.version(scraper_id, version)
        if text is None:
            raise LookupError(f"scraper {scraper_id} has no version {version}")
        return Strategy.from_json(text)

    def _pages(self, urls: list[str]) -> DataFrame:
        pages = self.source.fetch(self.spark.createDataFrame([(u,) for u in urls], "url string"))
        return pages.select("url", "html").cache()

    def _health(self, pages: DataFrame, strategy: Strategy, expected: int | None):
        run = self.spark.createDataFrame([(1,)], "run int")
        records = extract(pages, strategy, ["url"]).records.withColumn("run", F.lit(1))
        return health(records, ["run"], expected, runs=run, thresholds=self.thresholds)

    def preview(self, scraper_id: int, url: str, n: int = 10) -> DataFrame:
        return extract(self._pages([url]), self.active_strategy(scraper_id), ["url"]).records.orderBy("pos").limit(n)

    def run(self, scraper_id: int, url: str, expected: int | None = None, golden: DataFrame | None = None) -> tuple:
        """(health report, decision) of one cycle: fetch, extract, validate and, unless healthy, repair."""
        scraper, strategy = self.scraper(scraper_id), self.active_strategy(scraper_id)
        pages = self._pages([url])
        frame = self._health(pages, strategy, expected)
        row = frame.select("*", broken_fields().alias("_broken"), F.to_json(F.struct(*frame.columns)).alias("_json")).first()
        self.store.update(scraper_id, health_score=row.health_score, status=row.status)
        self.store.record_run(scraper_id, scraper.current_version, row, row["_json"])
        if row.status == "healthy":
            return row, Decision(scraper_id, scraper.current_version, scraper.current_version, "no_change", "already healthy", 1.0, row.health_score, row.health_score)
        return row, self._repair(scraper_id, scraper.current_version, strategy, pages, row, expected, golden)

    def _repair(self, scraper_id: int, old: int, strategy: Strategy, pages: DataFrame, report, expected, golden) -> Decision:
        why = ",".join(report.failure_signals)
        broken = list(report["_broken"])
        if not broken:
            self.store.record_repair(scraper_id, old, None, why or "unknown", 0, None, 0.0, json.dumps({"field_repairs": {}}), "reject")
            return Decision(scraper_id, old, None, "reject", "no viable candidates", 0.0, report.health_score, None)
        names = self.spark.createDataFrame([(f,) for f in broken], "field string")
        sick = pages.withColumns({"strategy": F.lit(strategy.to_json()), "broken_fields": F.array(*[F.lit(f) for f in broken])})
        extra = propose_with(self.provider, pages.join(names, F.lit(True)), ["url"], strategy) if self.provider else None
        plan = plans(repair(sick, ["url"], golden=golden, extra=extra)[0], ["url"]).first()
        new = proposed(strategy, plan.field_repairs)
        shadow = self._health(pages, new, expected).first()
        text = json.dumps([r.asDict() for r in plan.field_repairs], default=str)
        healthy = shadow.status == "healthy" and shadow.health_score >= self.thresholds.healthy
        if plan.all_promote and healthy:
            version = self.store.add_version(scraper_id, new.to_json(), why or "self-heal", plan.confidence)
            self.store.update(scraper_id, current_version=version, health_score=shadow.health_score, status=shadow.status)
            winner = next((json.dumps(r.asDict(), default=str) for r in plan.field_repairs if r.value is not None), None)
            self.store.record_repair(scraper_id, old, version, why or "unknown", plan.candidate_count, winner, plan.confidence, text, "promote")
            return Decision(scraper_id, old, version, "promote", f"shadow health {shadow.health_score:.2f} passes gate", plan.confidence, report.health_score, shadow.health_score)
        self.store.record_repair(scraper_id, old, None, why or "unknown", plan.candidate_count, None, plan.confidence, text, "shadow")
        return Decision(scraper_id, old, None, "shadow", f"shadow health {shadow.health_score:.2f}: not promoted (needs >= {self.thresholds.healthy})", plan.confidence, report.health_score, shadow.health_score)

    def run_now(self, scraper_id: int, url: str | None = None, expected: int | None = None, layout: str | None = None, golden: DataFrame | None = None) -> tuple:
        """``run`` with what a caller need not say: the registered address, ``RECORDS_EXPECTED`` records, and as many of the golden ones.

        ``layout`` switches the page store before; a source that cannot be switched raises.
        """
        target = url or self.scraper(scraper_id).target_url
        if layout:
            if not hasattr(self.source, "switch"):
                raise ValueError("this source has no layouts to switch to")
            self.source.switch(layout)
        expected = expected or RECORDS_EXPECTED
        return self.run(scraper_id, target, expected, golden if golden is None else golden.where(F.col("pos") < expected))

    def status(self) -> dict:
        """Whether the state can be read, the provider, whether a proxy is configured, and the number of scrapers."""
        n = self.store.table("scrapers").agg(F.count_distinct("id")).first()[0]
        return {"status": "ok", "provider": self.settings.provider, "proxy_configured": bool(self.settings.proxy), "scrapers": n}

    def version(self, scraper_id: int, version: int) -> Strategy:
        text = self.store.version(scraper_id, version)
        if text is None:
            raise LookupError(f"scraper {scraper_id} has no version {version}")
        return Strategy.from_json(text)

    def layouts(self) -> list[str]:
        """Names of the layouts that the page store holds, sorted; none for other sources."""
        pages = getattr(self.source, "pages", None)
        return [] if pages is None else [r.layout for r in pages.select("layout").distinct().orderBy("layout").collect()]

    def rollback(self, scraper_id: int, to_version: int, reason: str = "manual rollback") -> Decision:
        """Make a former version current; health stays and no version is deleted."""
        scraper = self.scraper(scraper_id)
        if self.store.version(scraper_id, to_version) is None:
            raise LookupError(f"scraper {scraper_id} has no version {to_version}")
        self.store.update(scraper_id, current_version=to_version)
        self.store.record_repair(scraper_id, scraper.current_version, to_version, reason, 0, None, 1.0, json.dumps({"kind": "rollback"}), "rollback")
        return Decision(scraper_id, scraper.current_version, to_version, "rollback", reason, 1.0, scraper.health_score, None)

    def history(self, scraper_id: int, n: int = 25) -> dict[str, DataFrame]:
        return {"versions": self.store.versions(scraper_id), "runs": self.store.runs(scraper_id, n), "repair_events": self.store.repair_events(scraper_id, n)}
