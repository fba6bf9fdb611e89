"""Pages as a table of nodes, and selectors as column expressions and windows over it.

A page is read once, from the parser's events; no tree is built. A node has its
place ``node`` in document order and the place ``last`` of its last descendant
(0 is the document, text counts as a node), so a descendant of x is a node with
x.node < node <= x.last. With that

* an ancestor that matches is seen by the running maximum of the matching
  nodes' ``last``: a node is inside one if that maximum reaches its own place;
* the first match under a record root is the next match after the root, if it
  is not beyond the root's ``last``;

so a selector of any length costs windows over one sort of a page's nodes, and
no join of nodes with nodes. A child combinator is the one equi-join, on the
parent.

The selectors are those that strategies and candidates use: tag, .class, #id,
[attr], [attr='value'], compounds of them, :nth-of-type(n), descendant (blank),
child (>) and lists. Anything else matches nothing.
"""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.html import feed
from ..functions.stage import large
from .dom import CODE, ENDS_P, ENDS_SAME, VOID
from .schema import Strategy

NODE = T.StructType([
    T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("element", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("nth", T.IntegerType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text_from", T.IntegerType()), T.StructField("text_to", T.IntegerType()), T.StructField("texts", T.ArrayType(T.StringType())),
])
_NAMES = NODE.names
#: nodes that leave a task together; a larger page leaves alone
ROWS = 1 << 14


class _Events(HTMLParser):
    """Rows of a page's nodes. ``element`` numbers the elements alone; text rows have no tag.

    ``text_from`` and ``text_to`` are places in the document row's ``texts``,
    which leaves out what scripts, styles and templates hold.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.rows: list[list] = [[0, None, 0, None, "", 1, {}, 0, 0, self.texts]]
        self.open: list[int] = [0]
        self.tags: list[dict[str, int]] = [{}]
        self.elements = self.hidden = 0

    def _shut(self) -> None:
        row = self.rows[self.open.pop()]
        self.tags.pop()
        row[2], row[8] = len(self.rows) - 1, len(self.texts)
        self.hidden -= row[4] in CODE

    def _end(self, tags, stops=frozenset()) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.rows[self.open[depth]][4]
            if tag in stops:
                return
            if tag in tags:
                while len(self.open) > depth:
                    self._shut()
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end({"p"}, {"table", "button"})
        if tag in ENDS_SAME:
            self._end(*ENDS_SAME[tag])
        seen = self.tags[-1]
        seen[tag] = seen.get(tag, 0) + 1
        place = len(self.rows)
        self.rows.append([place, self.open[-1], place, self.elements, tag, seen[tag], {k: v or "" for k, v in reversed(attrs)}, len(self.texts), len(self.texts), None])
        self.elements += 1
        if tag not in VOID:
            self.open.append(place)
            self.tags.append({})
            self.hidden += tag in CODE

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end({tag})

    def handle_data(self, data):
        if not self.hidden:
            place, at = len(self.rows), len(self.texts)
            self.texts.append(data)
            self.rows.append([place, self.open[-1], place, None, None, None, None, at, at + 1, None])

    def finish(self) -> list[list]:
        while self.open:
            self._shut()
        return self.rows


def nodes(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, NODE): the nodes of every page. A null or empty page has its document row alone."""
    schema = T.StructType([*[pages.schema[k] for k in keys], *NODE])
    arrow = to_arrow_schema(schema)

    def made(rows: list[list], name: str, n: int) -> pa.Array:
        kind = arrow.field(name).type
        if name != "attrs":
            return pa.array([r[n] for r in rows], kind)
        held = [r[n] or {} for r in rows]
        ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
        absent = pa.array([r[n] is None for r in rows])
        names, values = [k for d in held for k in d], [v for d in held for v in d.values()]
        return pc.if_else(absent, pa.nulls(len(rows), kind), pa.MapArray.from_arrays(pa.array(ends), pa.array(names, pa.string()), pa.array(values, pa.string())).cast(kind))

    def run(batches):
        for batch in batches:
            rows, at = [], []
            pages_ = batch.column("_html")
            for n in range(len(pages_)):
                events = _Events()
                feed(events, pages_[n].as_py())
                own = events.finish()
                rows += own
                at += [n] * len(own)
                if len(rows) >= ROWS or n + 1 == len(pages_):
                    held = [batch.column(k).take(pa.array(at, pa.int32())) for k in keys]
                    yield pa.RecordBatch.from_arrays([*held, *(made(rows, name, k) for k, name in enumerate(_NAMES))], names=arrow.names)
                    rows, at = [], []

    return pages.select(*keys, F.col(html).alias("_html")).mapInArrow(run, schema)


# ---- selectors

_NAME = r"[\w-]+"
_TEST = re.compile(rf"""(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[^\]\s"']+))\s*)?\]|:nth-of-type\(\s*(?P<nth>\d+)\s*\)""", re.VERBOSE)


def classes() -> Column:
    return F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != "")


def _compound(text: str) -> Column | None:
    """The test of one element; null if it cannot be read."""
    tests, at = [F.col("tag").isNotNull() & (F.col("node") > 0)], 0
    while at < len(text):
        m = _TEST.match(text, at)
        if not m or m["tag"] and at:
            return None
        at = m.end()
        if m["tag"]:
            tests += [F.col("tag") == m["tag"].lower()] if m["tag"] != "*" else []
        elif m["id"]:
            tests.append(F.col("attrs")["id"] == m["id"])
        elif m["cls"]:
            tests.append(F.array_contains(classes(), m["cls"]))
        elif m["nth"]:
            tests.append(F.col("nth") == int(m["nth"]))
        else:
            value = next((v for v in (m["dq"], m["sq"], m["raw"]) if v is not None), None)
            own = F.col("attrs")[m["attr"].lower()]
            tests.append(own.isNotNull() if value is None else own == value)
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def _steps(alternative: str) -> list[tuple[str, Column]] | None:
    """(combinator before it, test) of each compound, from left to right."""
    parts = re.split(r"\s*(>)\s*|\s+(?![^\[]*\])", alternative.strip())
    found, comb = [], ""
    for part in parts:
        if part == ">":
            comb = ">"
        elif part:
            test = _compound(part)
            if test is None or comb == ">" and not found:
                return None
            found.append((comb or (" " if found else ""), test))
            comb = ""
    return found if found and not comb else None


def matched(table: DataFrame, keys: list[str], selectors: dict[str, str]) -> DataFrame:
    """Append a boolean column for each name of ``selectors``: whether the node matches that selector."""
    out: dict[str, list[str]] = {name: [] for name in selectors}
    done: dict[str, list[tuple[str, Column]]] = {}
    for name, selector in selectors.items():
        read = [_steps(a) for a in re.split(r",(?![^\[]*\])", selector)]
        for n, steps in enumerate(read if all(read) else []):
            done[f"_m_{len(done)}_{n}"] = steps
            out[name].append(list(done)[-1])
    before = Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    depth = max((len(s) for s in done.values()), default=0)
    for level in range(depth):
        # all selectors' compounds of one level share a window, and one join if any asks for a parent
        now = {c: steps[level] for c, steps in done.items() if level < len(steps)}
        inside = {c: F.coalesce(F.max(F.when(F.col(c), F.col("last"))).over(before) >= F.col("node"), F.lit(False)) for c, (comb, _) in now.items() if comb == " "}
        children = [c for c, (comb, _) in now.items() if comb == ">"]
        if inside:
            table = table.withColumns({f"{c}_in": x for c, x in inside.items()})
        if children:
            above = table.where(reduce(Column.__or__, [F.col(c) for c in children])).select(*keys, F.col("node").alias("parent"), *[F.col(c).alias(f"{c}_in") for c in children])
            table = table.join(above, [*keys, "parent"], "left").withColumns({f"{c}_in": F.coalesce(f"{c}_in", F.lit(False)) for c in children})
        table = table.withColumns({c: test & F.col(f"{c}_in") if comb else test for c, (comb, test) in now.items()}).drop(*[f"{c}_in" for c in now])
    either = lambda names: reduce(Column.__or__, [F.col(c) for c in names]) if names else F.lit(False)
    return table.withColumns({name: either(names) for name, names in out.items()}).drop(*done)


#: white space at the ends, of any alphabet
_BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def text_of(first: str = "text_from", end: str = "text_to", texts: str = "texts") -> Column:
    """The text of a node from its document's texts: pieces stripped, blank ones left out, joined by one space."""
    pieces = F.transform(F.slice(texts, F.col(first) + 1, F.col(end) - F.col(first)), lambda x: F.regexp_replace(x, _BLANK, ""))
    return F.array_join(F.filter(pieces, lambda x: x != ""), " ")


def documents(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.where("node = 0").select(*keys, "texts")


def raw_values(table: DataFrame, keys: list[str], strategy: Strategy) -> DataFrame:
    """(keys, pos, one column per field): the raw value of each field under each record root, in document order.

    Selectors of kind css, attr-on-self, static and text-anchor; other kinds
    are null here. A root is no match of its own fields.
    """
    if not strategy.record_selector:
        raise ValueError("a strategy without record selector has no records")
    css = {f: s for f, s in strategy.fields.items() if s.kind == "css"}
    anchors = {f: s for f, s in strategy.fields.items() if s.kind == "text-anchor"}
    rows = matched(table, keys, {"_root": strategy.record_selector, **{f"_is_{f}": s.value for f, s in css.items()}})
    if anchors:
        # the document row is a page's first, and has the texts
        rows = rows.withColumn("_texts", F.first("texts").over(Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        said = F.lower(text_of(texts="_texts"))
        rows = rows.withColumns({f"_is_{f}": F.col("tag").isNotNull() & (F.col("node") > 0) & F.contains(said, F.lit(s.value.lower())) for f, s in anchors.items()}).drop("_texts")
    after = Window.partitionBy(*keys).orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    found = lambda f, s: F.struct("node", "text_from", "text_to", "parent", (F.col("attrs")[s.attr] if s.attr else F.lit(None).cast("string")).alias("attr"))
    following = {f"_at_{f}": F.last(F.when(F.col(f"_is_{f}"), found(f, s)), ignorenulls=True).over(after) for f, s in {**css, **anchors}.items()}
    selves = {f: s for f, s in strategy.fields.items() if s.kind == "attr-on-self"}
    rows = rows.withColumns({**following, **{f"_self_{f}": F.col("attrs")[s.attr or s.value] for f, s in selves.items()}})
    # a page's roots and its texts are in one partition already, so they meet without another reading or shuffle
    held = F.struct("node", "last", *[f"_at_{f}" for f in (*css, *anchors)], *[f"_self_{f}" for f in selves])
    met = rows.where(F.col("_root") | (F.col("node") == 0)).groupBy(*keys).agg(F.first(F.when(F.col("node") == 0, F.col("texts")), ignorenulls=True).alias("texts"), F.array_sort(F.collect_list(F.when(F.col("_root"), held))).alias("_roots"))
    roots = met.select(*keys, "texts", F.posexplode("_roots").alias("pos", "_r")).select(*keys, "texts", "pos", "_r.*")
    inside = lambda f: F.when(F.col(f"_at_{f}.node") <= F.col("last"), F.col(f"_at_{f}"))
    roots = roots.withColumns({f"_at_{f}": inside(f) for f in (*css, *anchors)})
    for f in anchors:
        roots = _around(table, keys, roots, f"_at_{f}", anchors[f].value, f"_text_{f}")

    def value(f: str) -> Column:
        s = strategy.fields[f]
        if s.kind == "css":
            there = F.col(f"_at_{f}").isNotNull()
            return F.when(there, F.col(f"_at_{f}.attr") if s.attr else text_of(f"_at_{f}.text_from", f"_at_{f}.text_to"))
        if s.kind == "attr-on-self":
            return F.col(f"_self_{f}")
        if s.kind == "text-anchor":
            return F.col(f"_text_{f}")
        return F.lit(s.value if s.kind == "static" else None).cast("string")

    return roots.select(*keys, "pos", *[value(f).alias(f) for f in strategy.fields])


def _around(table: DataFrame, keys: list[str], roots: DataFrame, at: str, label: str, name: str) -> DataFrame:
    """Append to roots, which have their page's texts: the texts of all children of the found node's parent, without the label."""
    children = table.select(*keys, F.col("parent").alias("_parent"), F.struct("node", "tag", "text_from", "text_to").alias("_kid"))
    met = roots.withColumn("_parent", F.col(f"{at}.parent")).join(large(children), [*keys, "_parent"], "left")
    piece = F.when(F.col("_kid.tag").isNull(), F.element_at("texts", F.col("_kid.text_from") + 1)).otherwise(text_of("_kid.text_from", "_kid.text_to"))
    pieces = F.collect_list(F.when(F.col("_kid").isNotNull(), F.struct(F.col("_kid.node").alias("node"), piece.alias("t"))))
    own = [c for c in roots.columns if c not in (*keys, "node")]
    around = met.groupBy(*keys, "node").agg(F.first(F.struct(*own)).alias("_own"), F.array_join(F.transform(F.array_sort(pieces), lambda x: x["t"]), "").alias("_all"))
    text = F.btrim(F.replace("_all", F.lit(label), F.lit("")), F.lit(" :·-"))
    return around.select(*keys, "node", "_own.*", F.when(F.col(f"_own.{at}").isNotNull(), text).alias(name))


def fingerprints(table: DataFrame, keys: list[str], limit: int = 2000, top: int = 20) -> DataFrame:
    """(keys, fingerprint): the commonest tag and class combinations of the first elements, with their counts.

    Ties are in the order of first appearance. Counts are summed in the tasks
    first; a page has ``limit`` rows at most and leaves ``top``.
    """
    name = F.concat_ws(".", "tag", F.array_sort(classes()))
    counted = table.where((F.col("element") < limit) & (F.col("node") > 0)).groupBy(*keys, name.alias("_k")).agg(F.count("*").alias("_n"), F.min("node").alias("_at"))
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), "_at"))).where(F.col("_r") <= top)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws("=", "_k", F.col("_n").cast("string")).alias("t")))), lambda x: x["t"]), ",")
    some = ranked.groupBy(*keys).agg(listed.alias("fingerprint"))
    return table.where("node = 0").select(*keys).join(some, keys, "left").select(*keys, F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def vocabulary(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, classes, data_attrs): a page's class names in lower case and its data attributes, sorted, each once."""
    elements = table.where("node > 0 AND tag IS NOT NULL")
    words = elements.select(*keys, F.explode(F.concat(F.transform(classes(), lambda c: F.struct(F.lit("classes").alias("kind"), F.lower(c).alias("word"))), F.transform(F.filter(F.map_keys("attrs"), lambda a: a.startswith("data-")), lambda a: F.struct(F.lit("data_attrs").alias("kind"), a.alias("word"))))).alias("w"))
    # each word once before the lists are made
    once = words.select(*keys, "w.kind", "w.word").distinct()
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("word")))).alias(kind)
    lists = once.groupBy(*keys).agg(of("classes"), of("data_attrs"))
    none = F.array().cast("array<string>")
    return table.where("node = 0").select(*keys).join(lists, keys, "left").select(*keys, F.coalesce("classes", none).alias("classes"), F.coalesce("data_attrs", none).alias("data_attrs"))
