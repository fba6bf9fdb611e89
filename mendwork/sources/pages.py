"""Page sources and the snapshot sink.

A source turns a frame of addresses into page snapshots (url, html,
status_code, provider, fetched_at), so a batch of pages is one DataFrame.
"""

from __future__ import annotations

import os
import random
import time
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import host_of, layout_and_page

SNAPSHOT = "url string, html string, status_code int, provider string, provider_meta map<string,string>, fetched_at double"


class ProviderUnavailable(RuntimeError):
    """The provider has no credentials or cannot be reached."""


@dataclass(frozen=True)
class Settings:
    """Configuration, read from a mapping when asked and passed on explicitly."""

    provider: str = "store"
    proxy: str = ""
    page_root: str = ""
    state: str = ""
    healthy_threshold: float = 0.90
    warning_threshold: float = 0.70

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(env.get("ACQUISITION_PROVIDER", "store"), env.get("ACQUISITION_PROXY", ""), env.get("PAGE_ROOT", ""), env.get("STATE_ROOT", ""), float(env.get("HEALTH_HEALTHY_THRESHOLD", "0.90")), float(env.get("HEALTH_WARNING_THRESHOLD", "0.70")))


class Source(Protocol):
    def available(self) -> bool: ...

    def fetch(self, urls: DataFrame) -> DataFrame: ...


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Files ``root/layout/page-N.html`` as (layout, page_no, html), one row per file."""
    files = spark.read.text(f"{root}/*/page-*.html", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    return files.select(F.regexp_extract("path", r"([^/]+)/page-\d+\.html$", 1).alias("layout"), F.regexp_extract("path", r"page-(\d+)\.html$", 1).cast("int").alias("page_no"), "html")


class PageStore:
    """Serves stored pages by layout and number; ``switch`` simulates a changed site."""

    def __init__(self, pages: DataFrame, layout: str = "v1_healthy") -> None:
        self.pages, self.layout = pages, layout

    def available(self) -> bool:
        return True

    def switch(self, layout: str) -> None:
        self.layout = layout

    def fetch(self, urls: DataFrame) -> DataFrame:
        """Snapshots of ``urls`` (url); an address without a page has status 404 and null html."""
        layout, page = layout_and_page("url", self.layout)
        wanted = urls.select("url", layout.alias("layout"), page.alias("page_no"))
        found = wanted.join(self.pages.select("layout", "page_no", "html"), ["layout", "page_no"], "left")
        meta = F.create_map(F.lit("layout"), F.col("layout"), F.lit("page"), F.col("page_no").cast("string"))
        return found.select("url", "html", F.when(F.col("html").isNull(), 404).otherwise(200).alias("status_code"), F.lit("store").alias("provider"), meta.alias("provider_meta"), F.unix_timestamp(F.current_timestamp()).cast("double").alias("fetched_at"))

    def require(self, urls: DataFrame) -> DataFrame:
        """Like ``fetch``, but a missing page raises FileNotFoundError."""
        got = self.fetch(urls)
        missing = got.where("status_code = 404").select("url").take(1)
        if missing:
            raise FileNotFoundError(f"no stored page for {missing[0].url}")
        return got


class ProxySource:
    """GET through an authenticated proxy, inside the tasks.

    A host's addresses are one task's, and its requests start ``delay`` seconds
    apart at least, whatever the number of tasks; a task with several hosts
    takes turns, so that it waits for none while another is free. User agents
    rotate. Errors raise. Certificates are checked only with ``verify``: a
    proxy that looks into the traffic has its own. A task that is repeated
    starts anew with the delay.
    """

    # A pool of browser identifications
    agents = tuple(f"Mozilla/5.0 ({system}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{v}.0 Safari/537.36" for system in ("Windows NT 10.0; Win64; x64", "X11; Linux x86_64") for v in (124, 125))

    def __init__(self, proxy: str, delay: float = 0.5, timeout: float = 30.0, verify: bool = False) -> None:
        self.proxy, self.delay, self.timeout, self.verify = proxy, delay, timeout, verify

    def available(self) -> bool:
        return bool(self.proxy)

    def fetch(self, urls: DataFrame) -> DataFrame:
        if not self.available():
            raise ProviderUnavailable("no proxy is configured")
        proxy, delay, timeout, verify, agents = self.proxy, self.delay, self.timeout, self.verify, list(self.agents)

        def get(batches):
            import ssl
            import urllib.request

            import pandas as pd

            context = ssl.create_default_context()
            if not verify:
                context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
            opener = urllib.request.build_opener(urllib.request.ProxyHandler({"http": proxy, "https": proxy}), urllib.request.HTTPSHandler(context=context))
            random.shuffle(agents)
            last, n = {}, 0
            for pdf in batches:
                rows = []
                for url, host in zip(pdf["url"], pdf["host"]):
                    time.sleep(max(0.0, last.get(host, 0.0) + delay - time.time()))
                    last[host] = time.time()
                    with opener.open(urllib.request.Request(url, headers={"User-Agent": agents[n % len(agents)]}), timeout=timeout) as answer:
                        rows.append((url, answer.read().decode("utf-8", "replace"), answer.status, "proxy", {"final_url": answer.url}, last[host]))
                    n += 1
                yield pd.DataFrame(rows, columns=["url", "html", "status_code", "provider", "provider_meta", "fetched_at"])

        turns = urls.select("url", F.coalesce(host_of("url"), F.lit("")).alias("host")).withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("url")))
        return turns.sortWithinPartitions("turn", "host").select("url", "host").mapInPandas(get, SNAPSHOT)


def make_source(settings: Settings, pages: DataFrame, layout: str = "v1_healthy") -> Source:
    """The configured provider, or the page store where it is not available."""
    if settings.provider == "proxy" and (proxy := ProxySource(settings.proxy)).available():
        return proxy
    return PageStore(pages, layout)


def snapshot_keys(pages: DataFrame) -> DataFrame:
    """Append host (as a folder name), content_sha (16 hex digits) and bytes (characters)."""
    host = F.regexp_replace(host_of("url"), "[^A-Za-z0-9._-]", "_")
    return pages.withColumns({"host": F.when(F.coalesce(host, F.lit("")) == "", "unknown").otherwise(host), "content_sha": F.substring(F.sha2("html", 256), 1, 16), "bytes": F.length("html")})


def write_snapshots(pages: DataFrame, path: str) -> None:
    """Append snapshots as Parquet by host, with their metadata beside the html."""
    snapshot_keys(pages).write.mode("append").partitionBy("host").parquet(path)
