"""Health reports as a stream, each held against the last good run of its scraper.

The last good report of a scraper is the state: a value in the state store,
found by the scraper, kept with the query's checkpoint. A restarted query goes
on with it, so the reports of a stream that stops and starts are those of
``detect_as_of`` over all of its runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import _BASELINE, _detected

#: what a health report must have here
REPORT = "run bigint, status string, health_score double, records_received bigint, null_rates map<string,double>, failure_signals array<string>, fingerprint string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastGood(StatefulProcessor):
    """Gives each report its baseline; a healthy one becomes the baseline of what follows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.good = handle.getValueState("good", "run bigint, report string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a scraper's runs of one batch come in any order
        batch = pd.concat(list(rows)).sort_values("run", kind="stable")
        run, good = self.good.get() if self.good.exists() else (None, None)
        out = []
        for own, healthy, report in zip(batch["run"], batch["healthy"], batch["report"]):
            out.append((key[0], int(own), report, good))
            if healthy and (run is None or own > run):
                run, good = int(own), report
        if good is not None:
            self.good.update((run, good))
        yield pd.DataFrame(out, columns=["scraper_id", "run", "report", "good"])

    def close(self) -> None:
        pass


def detections(reports: DataFrame, healthy: float = 0.90, critical_drop: float = 0.20, warning_drop: float = 0.05, critical_spike: float = 0.40) -> DataFrame:
    """Detection reports of a stream of health reports (scraper_id bigint and REPORT).

    A scraper's runs come in the order of ``run`` from batch to batch; within a
    batch they may come in any. A run that is later than its followers is held
    against the last good one that was known when it came. A batch holds the
    reports of one scraper at a time.
    """
    names = ["run", "status", "health_score", "records_received", "null_rates", "failure_signals", "fingerprint"]
    packed = reports.select("scraper_id", "run", (F.col("status") == "healthy").alias("healthy"), F.to_json(F.struct(*names)).alias("report"))
    kept = packed.groupBy("scraper_id").transformWithStateInPandas(LastGood(), "scraper_id bigint, run bigint, report string, good string", "Append", "None")
    rows = kept.withColumns({"_r": F.from_json("report", REPORT), "_g": F.from_json("good", REPORT)})
    rows = rows.select("scraper_id", "run", *[F.col(f"_r.{c}").alias(c) for c in names if c != "run"], *[F.col(f"_g.{c}").alias(f"_b_{c}") for c in _BASELINE])
    return _detected(rows, ["scraper_id", "run"], healthy, critical_drop, warning_drop, critical_spike)


def start(spark: SparkSession, source: str, out: str, checkpoint: str):
    """Read report files that came to ``source`` since the last start, append detections to ``out``, and stop."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    reports = spark.readStream.schema(f"scraper_id bigint, {REPORT}").parquet(source)
    return detections(reports).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
