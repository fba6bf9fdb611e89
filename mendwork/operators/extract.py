"""Extraction: pages to raw values to typed records.

A page is parsed inside its task, whatever number of selectors looks at it; the
html is dropped right after and never shuffled. A row leaves the task for each
record root. Raw values become typed columns by built-in expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import normalize as N
from ..functions.memo import memo
from ..functions.urls import base_of, join
from . import dom
from .dedupe import dedupe
from .schema import FIELDS, ID, KINDS, Strategy

RAW = T.StructType([T.StructField("raw", T.StringType()), T.StructField("transform", T.StringType())])
#: a page's own facts
PAGE = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("raw_len", T.LongType()),
    T.StructField("next_raw", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("data_attrs", T.ArrayType(T.StringType())),
    T.StructField("n_roots", T.IntegerType()),
])


#: pages that are held as Python objects at once
CHUNK = 256


def _raw_records(root: dom.Element, strategy: Strategy, values: dom.Values) -> list[list[str | None]]:
    return [values.of(e) for e in (dom.select(root, strategy.record_selector) if strategy.record_selector else ())]


def facts(html: str | None, strategy: Strategy) -> dict:
    root = dom.parse(html)
    values = dom.Values(strategy.fields)
    records = [[(f, {"raw": v, "transform": s.transform}) for (f, s), v in zip(strategy.fields.items(), got)] for got in _raw_records(root, strategy, values)]
    return {**page_facts(html, root, strategy), "records": records}


def page_facts(html: str | None, root: dom.Element, strategy: Strategy) -> dict:
    follow = next(dom.select(root, strategy.next_page_selector), None) if strategy.next_page_selector else None
    return {
        "fingerprint": dom.fingerprint(root),
        "raw_len": len(html or ""),
        "next_raw": None if follow is None else follow.attrs.get("href") or follow.attrs.get("data-next"),
        "classes": sorted({c.lower() for e in root.walk() for c in e.classes}),
        "data_attrs": sorted({a for e in root.walk() for a in e.attrs if a.startswith("data-")}),
        "n_roots": sum(1 for _ in dom.select(root, strategy.record_selector)) if strategy.record_selector else 0,
    }


def _chunks(batches):
    """(rows, html, strategy, field values) of a few pages at a time."""
    read: dict[str | None, tuple[Strategy, dom.Values]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            rows = batch.slice(at, CHUNK)
            texts = rows.column("_strategy").to_pylist()
            for text in texts:
                if text not in read:
                    read[text] = _opened(text)
            yield rows, rows.column("_html").to_pylist(), [read[t] for t in texts]
            if len(read) > 4096:
                read.clear()


def _opened(text: str | None) -> tuple[Strategy, dom.Values]:
    own = Strategy.from_json(text) if text else Strategy("none", "")
    return own, dom.Values(own.fields)


def parse_pages(pages: DataFrame, keys: list[str], html: str = "html", strategy: str = "strategy") -> DataFrame:
    """One row per page: keys and PAGE. ``strategy`` is a column with a strategy's JSON.

    A null page is an empty one. A page with a null strategy has no records.
    """
    schema = T.StructType([*[pages.schema[k] for k in keys], *PAGE])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch, texts, strategies in _chunks(batches):
            rows = [page_facts(text, dom.parse(text), own) for text, (own, _) in zip(texts, strategies)]
            made = [pa.array([r[f.name] for r in rows], arrow.field(f.name).type) for f in PAGE]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made], names=arrow.names)

    return pages.select(*keys, F.col(html).alias("_html"), F.col(strategy).alias("_strategy")).mapInArrow(run, schema)


def parse_records(pages: DataFrame, keys: list[str], html: str = "html", strategy: str = "strategy") -> DataFrame:
    """One row per record root, in document order: keys, ``pos`` and ``_r``, the raw values by field. Pages as for ``parse_pages``."""
    names = (ID, *FIELDS)
    schema = T.StructType([*[pages.schema[k] for k in keys], T.StructField("pos", T.IntegerType()), T.StructField("_r", T.StructType([T.StructField(f, RAW) for f in names]))])
    arrow = to_arrow_schema(schema)
    kinds = arrow.field("_r").type

    def run(batches):
        for batch, texts, strategies in _chunks(batches):
            at, pos = [], []
            raws, transforms = {f: [] for f in names}, {f: [] for f in names}
            for n, (text, (own, values)) in enumerate(zip(texts, strategies)):
                records = _raw_records(dom.parse(text), own, values)
                at += [n] * len(records)
                pos += range(len(records))
                place = {f: k for k, f in enumerate(own.fields)}
                for f in names:
                    k = place.get(f)
                    raws[f] += [None] * len(records) if k is None else [r[k] for r in records]
                    transforms[f] += [None if k is None else own.fields[f].transform] * len(records)
            held = [batch.column(k).take(pa.array(at, pa.int32())) for k in keys]
            made = pa.StructArray.from_arrays([pa.StructArray.from_arrays([pa.array(raws[f], pa.string()), pa.array(transforms[f], pa.string())], fields=list(kinds.field(f).type)) for f in names], fields=list(kinds))
            yield pa.RecordBatch.from_arrays([*held, pa.array(pos, pa.int32()), made], names=arrow.names)

    return pages.select(*keys, F.col(html).alias("_html"), F.col(strategy).alias("_strategy")).mapInArrow(run, schema)


def typed(field: str, raw: Column, transform: Column, base: Column) -> tuple[Column, Column]:
    """(value of the field's type, text of a value of another type) of one raw value."""
    number, whole, text = N.number_of(raw, transform), F.when(transform.isin(*N.INTS), N.parse_int(raw)), N.text_of(raw, transform, base, field)
    if field == "availability":
        text = N.parse_availability(text)
    kind = KINDS.get(field)
    if kind == "double":
        return F.coalesce(number, whole.cast("double")), text
    if kind == "bigint":
        return whole, F.coalesce(text, N.float_text(number))
    return text, F.coalesce(N.float_text(number), whole.cast("string"))


def records_of(parsed: DataFrame, keys: list[str], url: Column) -> DataFrame:
    """Typed records of parsed pages in document order, before deduplication."""
    rows = parsed.select(*keys, base_of(url).alias("_base"), F.posexplode("records").alias("pos", "_r"))
    return rows.select(*keys, "pos", *record_columns())


@memo
def record_columns() -> list[Column]:
    """Typed fields and loose values from the raw values in ``_r`` and the base address in ``_base``."""
    columns, loose = [], []
    for f in (ID, *FIELDS):
        got = F.col("_r")[f]
        value, other = typed(f, got["raw"], got["transform"], F.col("_base"))
        columns.append(value.alias(f))
        loose.append(F.when(other.isNotNull(), F.struct(F.lit(f).alias("key"), other.alias("value"))))
    return [*columns, F.map_from_entries(F.filter(F.array(*loose), lambda x: x.isNotNull())).alias("loose")]


class Extraction:
    """Result of ``extract``: records, pages (key, fingerprint, raw_len, next_page_url, ...) and the dedupe report."""

    def __init__(self, records: DataFrame, pages: DataFrame, report: DataFrame | None) -> None:
        self.records, self.pages, self.report = records, pages, report


def extract(pages: DataFrame, strategy: Strategy | str, keys: list[str] | None = None, url: str = "url", html: str = "html", deduplicate: bool = True) -> Extraction:
    """Extract typed records from all pages.

    ``strategy`` is one strategy for all pages or the name of a column with the
    JSON of each page's own. ``keys`` (default: the url) identify a page.
    Missing fields are null; a page without records is in ``pages`` only.
    """
    keys = keys or [url]
    own = pages.withColumn("_strategy", F.lit(strategy.to_json()) if isinstance(strategy, Strategy) else F.col(strategy))
    held = [*dict.fromkeys([*keys, url])]
    # records and facts are parsed apart: what asks for one alone makes nothing of the other
    records = parse_records(own, held, html, "_strategy").select(*held, base_of(F.col(url)).alias("_base"), "pos", "_r").select(*keys, "pos", *record_columns())
    parsed = parse_pages(own, held, html, "_strategy")
    facts_ = parsed.select(*held, "fingerprint", "raw_len", F.when(F.col("next_raw") != "", join(F.col(url), F.col("next_raw"))).alias("next_page_url"), "classes", "data_attrs", "n_roots")
    if not deduplicate:
        return Extraction(records, facts_, None)
    unique, report = dedupe(records, keys)
    return Extraction(unique, facts_, report)
