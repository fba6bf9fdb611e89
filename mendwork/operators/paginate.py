"""Paginated extraction: follow next-page links of stored pages and join what the pages give.

Pages are parsed all together, for their links and for their records; the links
make a table of (site, url, next). Chains are followed by pointer jumping: after k rounds a
page knows the 2^k pages behind it, so twenty pages take five joins of the link
table with itself, and a round is left out once no chain is open. Only
addresses move in these rounds, never html or records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import large, stage
from .extract import extract
from .schema import Strategy

MAX_PAGES = 20


@dataclass(frozen=True)
class Pagination:
    """``records``: the keys, start, hop (the page's number on the way, from 0), page (its url), place (from 0 over
    the whole way) and the record. ``runs``: a row per start with n_pages, pages, stopped, fingerprint of the last page
    and raw_len, the number of records. ``stopped`` is why no page follows: ``end`` (no link), ``repeat`` (the link
    leads back), ``limit`` or ``missing`` (no such page)."""

    records: DataFrame
    runs: DataFrame


def follow(links: DataFrame, keys: list[str], max_pages: int = MAX_PAGES, url: str = "url", target: str = "next_page_url") -> DataFrame:
    """(keys, url, pages, stopped): the way from every page, itself first, without repeats, ``max_pages`` at most.

    ``links`` has a row per page; ``target`` is null where there is no link. If
    an address is there twice, the smallest link counts; a null address is no
    page. A link that leads nowhere ends the way before it.
    """
    pages = links.where(F.col(url).isNotNull()).groupBy(*keys, F.col(url).alias("_at")).agg(F.min(F.when(F.col(target) != "", F.col(target))).alias("_next"))
    there = pages.select(*keys, F.col("_at").alias("_next"), F.lit(True).alias("_known"))
    none = F.array().cast("array<string>")
    # _to: the last page known so far if the way may go on behind it; _dead: a link without a page
    ways = stage(
        pages.join(large(there), [*keys, "_next"], "left").select(
            *keys, "_at", F.when(F.col("_known"), F.array("_next")).otherwise(none).alias("_path"), F.when(F.col("_known"), F.col("_next")).alias("_to"),
            F.when(F.col("_known").isNull(), F.col("_next")).alias("_dead"),
        )
    )
    reach = 1
    # a way of ``max_pages`` pages needs as many links to tell a limit from a repeat
    while reach < max_pages and not ways.where("_to IS NOT NULL").isEmpty():
        on = ways.select(*keys, F.col("_at").alias("_to"), F.col("_path").alias("_more"), F.col("_to").alias("_far"), F.col("_dead").alias("_lost"))
        ways = stage(
            ways.join(large(on), [*keys, "_to"], "left").select(
                *keys, "_at", F.concat("_path", F.coalesce("_more", none)).alias("_path"), F.col("_far").alias("_to"),
                F.when(F.col("_to").isNull(), F.col("_dead")).otherwise(F.col("_lost")).alias("_dead"),
            )
        )
        reach *= 2
    way = F.concat(F.array("_at"), F.col("_path"))
    once = F.array_distinct(way)
    # every page has one link, so behind the first repeat there are repeats only
    stopped = (
        F.when(F.size(once) > max_pages, "limit")
        .when(F.size(once) < F.size(way), "repeat")
        .when(F.col("_to").isNotNull(), "limit")
        .when(F.col("_dead").isNotNull(), F.when(F.size(once) >= max_pages, "limit").otherwise("missing"))
        .otherwise("end")
    )
    return ways.select(*keys, F.col("_at").alias(url), F.slice(once, 1, max_pages).alias("pages"), stopped.alias("stopped"))


def extract_all(pages: DataFrame, starts: DataFrame, strategy: Strategy | str, keys: list[str] | None = None, url: str = "url", html: str = "html", max_pages: int = MAX_PAGES) -> Pagination:
    """Records of all pages on the way from each start, in order; duplicates go within a page, not across pages.

    ``pages`` holds all stored pages of the sites (``keys``), ``starts`` the
    addresses to begin at (keys and ``url``), each once. A start without a page
    is in ``runs`` with no pages, ``missing`` and no records. Pages that no way
    meets are parsed, as the links are only known then, and leave no record.
    """
    keys = list(keys or [])
    got = extract(pages, strategy, [*keys, url], url, html)
    facts = stage(got.pages.select(*keys, url, "next_page_url", "fingerprint"))
    begun = starts.select(*keys, F.col(url).alias("start")).distinct()
    ways = begun.join(large(follow(facts, keys, max_pages, url).withColumnRenamed(url, "start")), [*keys, "start"], "left")
    ways = stage(ways.select(*keys, "start", F.coalesce("pages", F.array().cast("array<string>")).alias("pages"), F.coalesce("stopped", F.lit("missing")).alias("stopped")))
    hops = ways.select(*keys, "start", F.posexplode("pages").alias("hop", url))
    own = [c for c in got.records.columns if c not in (*keys, url)]
    found = hops.join(large(got.records), [*keys, url])
    way = Window.partitionBy(*keys, "start").orderBy("hop", "pos")
    records = found.select(*keys, "start", "hop", F.col(url).alias("page"), (F.row_number().over(way) - 1).alias("place"), *own)
    counts = found.groupBy(*keys, "start").agg(F.count("*").alias("raw_len"))
    last: Column = F.element_at("pages", F.size("pages"))
    prints = facts.groupBy(*keys, F.col(url).alias("_last")).agg(F.min("fingerprint").alias("fingerprint"))
    ends = ways.withColumn("_last", F.when(F.size("pages") > 0, last)).join(large(prints), [*keys, "_last"], "left").join(large(counts), [*keys, "start"], "left")
    runs = ends.select(*keys, "start", F.size("pages").cast("long").alias("n_pages"), "pages", "stopped", "fingerprint", F.coalesce("raw_len", F.lit(0)).cast("long").alias("raw_len"))
    return Pagination(records, runs)
