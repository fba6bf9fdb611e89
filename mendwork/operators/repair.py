"""Repair: generate, test, score, rank and gate candidates for broken fields.

A page is parsed once, in one task, for everything that repair asks of it: the
records under the present strategy, the vocabulary that decides which
candidates there are, and the raw values of all candidates at all record
roots. What leaves the task has no html and is written once; the swapped field
alone is read again from it, the other fields come from the present records.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import normalize as N
from ..functions.memo import memo
from ..functions.stage import large, stage
from ..functions.urls import base_of
from . import dom
from .candidates import templates
from .dedupe import dedupe
from .extract import CHUNK, RAW, records_of
from .schema import FIELDS, ID, KINDS, Selector, Strategy
from .score import TOP_K, WEIGHTS, field_scores, gate, rank

_TEXTS = ("kind", "value", "attr", "transform", "source", "rationale")
CANDIDATE = T.StructType([T.StructField("field", T.StringType()), T.StructField("gen_ord", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in _TEXTS]])
PROBE = T.StructType([
    T.StructField("records", T.ArrayType(T.MapType(T.StringType(), RAW))),
    T.StructField("candidates", T.ArrayType(T.StructType([*CANDIDATE, T.StructField("like", T.IntegerType()), T.StructField("raws", T.ArrayType(T.StringType()))]))),
])


class _Root:
    """First matches under one record root, looked up by what candidates ask for; one walk for all of them."""

    def __init__(self, root: dom.Element) -> None:
        self.root, self.first, self.texts = root, {}, {}
        numbers: dict[tuple[int, str], int] = {}
        for e in root.walk():
            nth = numbers[id(e.parent), e.tag] = numbers.get((id(e.parent), e.tag), 0) + 1
            keys = [(("tag", e.tag),), (("tag", e.tag), ("nth", nth))]
            for c in e.classes:
                keys += [(("class", c),), (("tag", e.tag), ("class", c))]
            for name, value in e.attrs.items():
                keys += [(("has", name),), (("tag", e.tag), ("has", name)), (("is", name, value),)]
            for key in keys:
                self.first.setdefault(key, e)

    @staticmethod
    def key(selector: str) -> tuple | None:
        """What ``first`` has for a selector of one compound; null for others."""
        steps = dom.compiled(selector)
        if len(steps) != 1 or len(steps[0]) != 1:
            return None
        out = []
        for kind, name, op, value in steps[0][0][1]:
            if kind == "attr" and op in (None, "="):
                out.append(("has", name) if op is None else ("is", name, value))
            elif kind in ("tag", "class"):
                out.append((kind, name))
            elif kind == "pseudo" and name == "nth-of-type" and len(out) == 1:
                out.append(("nth", value))
            else:
                return None
        return tuple(out) if len(out) == 1 or len(out) == 2 and out[0][0] == "tag" and out[1][0] in ("class", "has", "nth") else None

    def value(self, kind: str, value: str, attr: str | None, key: tuple | None) -> str | None:
        if kind != "css" or key is None:
            return dom.first_value(self.root, kind, value, attr)
        e = self.first.get(key)
        if e is None or attr:
            return None if e is None else e.attrs.get(attr)
        if id(e) not in self.texts:
            self.texts[id(e)] = e.text()
        return self.texts[id(e)]


def probe(pages: DataFrame, keys: list[str], html: str = "html", strategy: str = "strategy", given: str | None = None) -> DataFrame:
    """(keys, PROBE) of each page with its ``broken_fields``: present raw records, and candidates with their raw values.

    ``given`` names an array of further CANDIDATE structs of the page: those of
    source ``historical`` count unless the same selector is there already,
    others always. Candidates are in the order of ``gen_ord``. ``like`` is the
    ``gen_ord`` of the first candidate of the field with the same transform and
    raw values, whose records and scores are the same.
    """
    schema = T.StructType([*[pages.schema[k] for k in keys], *PROBE])
    arrow = to_arrow_schema(schema)
    table = {f: templates(f) for f in (*FIELDS, "")}

    def candidates(field: str, words: set[str], attrs: set[str], more: list[dict]):
        seen = set()
        for n, c in enumerate(table.get(field, table[""])):
            need = c["needs"]
            if need is None or need in attrs or need[:1] == "." and need[1:] in words:
                seen.add((c["kind"], c["value"], c["attr"]))
                yield {"field": field, "gen_ord": n, **{k: c[k] for k in _TEXTS}}
        for c in sorted(more, key=lambda c: c["gen_ord"]):
            same = (c["kind"], c["value"], c["attr"])
            if c["source"] != "historical" or same not in seen:
                seen.add(same)
                yield c

    def probed(page: str | None, own: Strategy, broken: list[str], more: list[dict]) -> dict:
        root = dom.parse(page)
        words, attrs = {c.lower() for e in root.walk() for c in e.classes}, {a for e in root.walk() for a in e.attrs if a.startswith("data-")}
        roots = [_Root(e) for e in (dom.select(root, own.record_selector) if own.record_selector else ())]
        known = {f: _Root.key(s.value) if s.kind == "css" else None for f, s in own.fields.items()}
        made = []
        for field in broken:
            first: dict[tuple, int] = {}
            for c in candidates(field, words, attrs, [m for m in more if m["field"] == field]):
                key = _Root.key(c["value"]) if c["kind"] == "css" else None
                raws = [r.value(c["kind"], c["value"], c["attr"], key) for r in roots]
                made.append({**c, "like": first.setdefault((c["transform"], *raws), c["gen_ord"]), "raws": raws})
        return {"records": [[(f, {"raw": r.value(s.kind, s.value, s.attr, known[f]), "transform": s.transform}) for f, s in own.fields.items()] for r in roots], "candidates": made}

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                columns = [batch.column(c).to_pylist() for c in ("_html", "_strategy", "broken_fields", "_given")]
                rows = [probed(page, Strategy.from_json(text), broken or [], more or []) for page, text, broken, more in zip(*columns)]
                made = [pa.array([r[f.name] for r in rows], arrow.field(f.name).type) for f in PROBE]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made], names=arrow.names)

    more = F.col(given) if given else F.lit(None).cast(T.ArrayType(CANDIDATE))
    return pages.select(*dict.fromkeys([*keys, "broken_fields"]), F.col(html).alias("_html"), F.col(strategy).alias("_strategy"), more.alias("_given")).mapInArrow(run, schema)


@memo
def _swap() -> tuple[list[Column], list[Column]]:
    """One value of each kind from ``raw``, and the record's columns, of which the field's own takes the value of its type."""
    raw, transform = F.col("raw"), F.col("transform")
    read = [
        N.number_of(raw, transform).alias("_number"),
        F.when(transform.isin(*N.INTS), N.parse_int(raw)).alias("_whole"),
        F.when(F.col("field") == "availability", N.parse_availability(N.text_of(raw, transform, F.col("_base"), "availability"))).otherwise(N.text_of(raw, transform, F.col("_base"), "")).alias("_text"),
    ]
    as_text = F.coalesce(N.float_text(F.col("_number")), F.col("_whole").cast("string"))
    kinds = {"double": (F.coalesce(F.col("_number"), F.col("_whole").cast("double")), F.col("_text")), "bigint": (F.col("_whole"), F.coalesce(F.col("_text"), N.float_text(F.col("_number")))), None: (F.col("_text"), as_text)}
    columns = [F.col(ID), *[F.when(F.col("field") == f, kinds[KINDS.get(f)][0]).otherwise(F.col(f)).alias(f) for f in FIELDS]]
    other = F.when(F.col("field").isin(*[f for f in FIELDS if KINDS.get(f) == "double"]), kinds["double"][1]).when(F.col("field") == "review_count", kinds["bigint"][1]).otherwise(as_text)
    kept = F.map_filter("loose", lambda k, _: k != F.col("field"))
    loose = F.when(other.isNotNull(), F.map_concat(kept, F.create_map("field", other))).otherwise(kept)
    return read, [*columns, loose.alias("loose")]


def swapped_records(values: DataFrame, base: DataFrame, keys: list[str], url: str) -> DataFrame:
    """Records as they would be under each candidate, deduplicated again by page and candidate."""
    rows = values.select(*keys, "field", "gen_ord", "transform", base_of(F.col(url)).alias("_base"), F.posexplode("raws").alias("pos", "raw"))
    joined = rows.join(large(base), [*keys, "pos"])
    read, columns = _swap()
    records = joined.select("*", *read).select(*keys, "field", "gen_ord", "pos", *columns)
    return dedupe(records, [*keys, "field", "gen_ord"])[0]


def repair(
    broken: DataFrame,
    keys: list[str],
    url: str = "url",
    html: str = "html",
    strategy: str = "strategy",
    golden: DataFrame | None = None,
    historical: DataFrame | None = None,
    historical_values: DataFrame | None = None,
    extra: DataFrame | None = None,
    top_k: int = TOP_K,
    site: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(field repairs, scored candidates).

    ``broken`` has a row per page with its keys (the url may be one), html,
    strategy (JSON) and ``broken_fields`` (array). A field repair has the
    winner, its scores, action and reason, and the number of candidates kept
    (``top_k`` at most). A field without candidates is rejected. ``golden`` is
    joined on ``pos`` and the ``site`` columns, which are among the keys.
    ``historical`` (keys, field, kind, value, attr, transform, ord) are former
    selectors, appended unless already there; ``extra`` (same columns and
    rationale) are a plug-in's, appended as they are. ``historical_values``
    (field, value and any of the keys) are former values.
    """
    held = [*dict.fromkeys([*keys, url])]
    pages, given = broken, None
    if historical is not None or extra is not None:
        # few rows: former selectors and a plug-in's proposals go to the pages
        listed = _given(historical, extra, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("_given"))
        pages, given = broken.join(large(listed), keys, "left"), "_given"
    probed = stage(probe(pages, [*held, "broken_fields"], html, strategy, given))
    base = records_of(probed, keys, F.col(url))
    tested = probed.select(*held, F.explode("candidates").alias("_c")).select(*held, "_c.*")
    made = tested.select(*keys, *CANDIDATE.names, "like")
    records = swapped_records(tested.where("like = gen_ord"), base, keys, url)
    found = field_scores(records, [*keys, "gen_ord"], golden, historical_values, site).withColumnRenamed("gen_ord", "like")
    # a candidate that gives no records scores zero, with the neutral share for its missing history
    scored = made.join(large(found), [*keys, "field", "like"], "left").fillna(0.0, subset=[*WEIGHTS, "total"]).drop("like")
    ranked = rank(scored, keys)
    action, reason = gate()
    shown = F.struct("kind", "value", "attr", "transform", "source", "rationale", *WEIGHTS, "total")
    best = scored.groupBy(*keys, "field").agg(
        F.min_by(shown, F.struct(-F.col("total"), "gen_ord")).alias("_w"), F.least(F.lit(top_k), F.count("*")).cast("int").alias("candidate_count"), F.count("*").alias("generated")
    )
    asked = probed.select(*keys, F.explode("broken_fields").alias("field"))
    repairs = asked.join(large(best), [*keys, "field"], "left").select(*keys, "field", "_w.*", *[F.coalesce(c, F.lit(0)).cast(k).alias(c) for c, k in (("candidate_count", "int"), ("generated", "bigint"))])
    return repairs.withColumns({"action": action, "reason": reason}), ranked


def plans(repairs: DataFrame, keys: list[str]) -> DataFrame:
    """A plan per page: its field repairs as an array, confidence, whether all promote, candidate count."""
    names = [c for c in repairs.columns if c not in keys]
    used = F.col("action").isin("promote", "shadow")
    return repairs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("field", *[c for c in names if c != "field"]))).alias("field_repairs"),
        F.bround(F.coalesce(F.avg(F.when(used, F.col("total"))), F.lit(0.0)), 4).alias("confidence"),
        F.every(F.col("action") == "promote").alias("all_promote"),
        F.sum("candidate_count").cast("int").alias("candidate_count"),
    )


def proposed(strategy: Strategy, field_repairs: list) -> Strategy:
    """The strategy with promoted and shadow winners in place."""
    fields = dict(strategy.fields)
    for r in field_repairs:
        if r["action"] in ("promote", "shadow"):
            fields[r["field"]] = Selector(r["kind"], r["value"], r["attr"], r["transform"])
    return Strategy(f"{strategy.name}-repair", strategy.record_selector, fields, strategy.next_page_selector, "repaired")


def _given(historical: DataFrame | None, extra: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, c): CANDIDATE structs of former selectors and of a plug-in, in this order."""
    parts = []
    for rows, first, source, why in ((historical, 1_000_000, "historical", F.lit("previously deployed selector")), (extra, 2_000_000, "llm", F.col("rationale"))):
        if rows is not None:
            columns = {"field": F.col("field"), "gen_ord": (F.lit(first) + F.col("ord")).cast("int"), **{c: F.col(c) for c in _TEXTS[:4]}, "source": F.lit(source), "rationale": why}
            parts.append(rows.select(*keys, F.struct(*[columns[f.name].alias(f.name) for f in CANDIDATE]).alias("c")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


SELECTOR = "struct<kind:string,value:string,attr:string,transform:string>"
STRATEGY = f"name string, record_selector string, fields map<string,{SELECTOR}>, next_page_selector string, notes string"


def proposed_json(strategy: Column | str, field_repairs: Column | str) -> Column:
    """The JSON of a strategy with the promoted and shadow winners of ``field_repairs`` in their places, others behind."""
    old = F.from_json(strategy, STRATEGY)
    used = F.filter(field_repairs, lambda r: r["action"].isin("promote", "shadow"))
    new = F.map_from_entries(F.transform(used, lambda r: F.struct(r["field"], F.struct(r["kind"], r["value"], r["attr"], r["transform"]))))
    kept = F.transform_values(old["fields"], lambda k, v: F.coalesce(new[k], v))
    fields = F.map_concat(kept, F.map_filter(new, lambda k, _: ~F.map_contains_key(old["fields"], k)))
    return F.to_json(F.struct(F.concat(old["name"], F.lit("-repair")).alias("name"), old["record_selector"].alias("record_selector"), fields.alias("fields"), old["next_page_selector"].alias("next_page_selector"), F.lit("repaired").alias("notes")))


def with_proposed(plan: DataFrame, strategy: str) -> DataFrame:
    """Append the proposed strategy's JSON to plans; ``strategy`` names the column with the old one's."""
    return plan.withColumn("proposed", proposed_json(F.col(strategy), F.col("field_repairs")))
