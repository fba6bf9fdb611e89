"""Page files as a stream: every micro-batch runs the batch plan. ``baseline`` has the stream that keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract
from ..operators.health import health
from ..operators.schema import Strategy


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of Parquet page files with (site, url, html)."""
    return spark.readStream.schema("site string, url string, html string").parquet(path)


def health_stream(pages: DataFrame, strategy: Strategy, expected: int | None, out: str, checkpoint: str):
    """Start a query that appends a health report per site and micro-batch to ``out``."""

    def batch(df: DataFrame, number: int) -> None:
        records = extract(df, strategy, ["site", "url"]).records
        reports = health(records, ["site"], expected, runs=df.select("site").distinct())
        # a batch that runs again after a failure replaces its own folder
        reports.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and failures by type in windows of event time; later ones than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
