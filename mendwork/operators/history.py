"""What is known of a scraper before a run: selectors that were deployed and values that were extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repair import STRATEGY
from .schema import FIELDS
from .score import shown


def former_selectors(versions: DataFrame, runs: DataFrame | None = None, key: str = "scraper_id") -> DataFrame:
    """(key, field, kind, value, attr, transform, ord): every selector of a scraper's versions, in the order in which they first came.

    ``versions``: key, version, strategy (JSON) and seq. ``runs`` (key, seq):
    versions that came at the run or later are left out, so that a run in the
    past is repaired by what was known then. A selector counts once.
    """
    rows = versions if runs is None else versions.join(runs.select(key, F.col("seq").alias("_run")), key).where("seq < _run")
    fields = rows.select(key, "version", F.explode(F.from_json("strategy", STRATEGY)["fields"]).alias("field", "_s"))
    names = ("kind", "value", "attr", "transform")
    return fields.groupBy(key, "field", *[F.col(f"_s.{c}").alias(c) for c in names]).agg(F.min("version").alias("ord"))


def former_values(records: DataFrame, runs: DataFrame | None = None, key: str = "scraper_id") -> DataFrame:
    """(key, field, value): the values of all fields in a scraper's earlier records, each once, as text.

    ``records`` has the record schema, the key and, if ``runs`` is given, the
    seq of the run that extracted it. Values are counted once in the tasks, so
    what moves is the distinct ones; membership is a join on them.
    """
    rows = records if runs is None else records.join(runs.select(key, F.col("seq").alias("_run")), key).where("seq < _run")
    values = rows.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), shown(f).alias("value")) for f in FIELDS])).alias("v"))
    return values.select(key, "v.field", "v.value").where("value IS NOT NULL").distinct()
