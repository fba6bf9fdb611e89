"""Token counts by section, from one encoding of the whole document.

A text is encoded once; every token's span of bytes is known from the
vocabulary (byte-level tokens concatenate to the text), and an interval join
of token spans with section spans, by sorted boundaries, gives each token to a
section. A token that crosses a boundary is given by an explicit rule:

* ``start``: to the section with its first byte,
* ``majority``: to the section with most of its bytes, the first one on a tie,
* ``split``: to all of them, in proportion to their bytes.

Sections are the text's lines, or a column of spans in code points. Nothing is
shuffled: a document's join stays within its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts
from .tokens import VOCABULARY, ByteBpe

RULES = ("start", "majority", "split")


def line_spans(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of \\n-split lines, each with its line feed; the empty text is one empty line."""
    cuts = np.flatnonzero(np.frombuffer(b, dtype=np.uint8) == 10) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(b)]])


def byte_spans(b: bytes, spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans from spans in code points, which may be in any order but not overlap."""
    lead = np.flatnonzero((np.frombuffer(b, dtype=np.uint8) & 0xC0) != 0x80)
    at = np.append(lead, len(b))
    clip = lambda key: at[np.clip([s[key] or 0 for s in spans], 0, len(lead)).astype(np.int64)] if spans else np.zeros(0, dtype=np.int64)
    return clip("start"), clip("end")


def attribute(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens by section, crossing tokens by section, tokens of no section).

    ``lengths``: bytes of the tokens; sections in the order of their starts.
    A crossing token counts as crossing in every section it touches.
    """
    n = len(starts)
    stop = np.cumsum(lengths)
    start = stop - lengths
    if not n or not len(lengths):
        return np.zeros(n), np.zeros(n, dtype=np.int64), float(len(lengths))
    full = ends > starts
    own, own_ends = starts[full], ends[full]
    where = np.flatnonzero(full)
    if not len(own):
        return np.zeros(n), np.zeros(n, dtype=np.int64), float(len(lengths))
    first = np.searchsorted(own_ends, start, "right")  # the first section that ends after the token starts
    last = np.searchsorted(own, stop, "left") - 1  # the last one that starts before it ends
    inside = (first == last) & (own[np.minimum(first, len(own) - 1)] <= start) & (own_ends[np.minimum(first, len(own) - 1)] >= stop)
    counts = np.bincount(where[first[inside]], minlength=n).astype(float)
    crossing = np.zeros(n, dtype=np.int64)
    outside = 0.0
    for i in np.flatnonzero(~inside):
        touched = np.arange(first[i], last[i] + 1)
        share = np.minimum(own_ends[touched], stop[i]) - np.maximum(own[touched], start[i])
        crossing[where[touched]] += 1
        if rule == "split":
            counts[where[touched]] += share / lengths[i]
            outside += 1 - share.sum() / lengths[i]
        elif rule == "start":
            if len(touched) and own[touched[0]] <= start[i]:
                counts[where[touched[0]]] += 1
            else:
                outside += 1
        elif len(touched) and share.max() >= lengths[i] - share.sum():
            counts[where[touched[int(share.argmax())]]] += 1
        else:
            outside += 1
    return counts, crossing, outside


def token_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sections: str | None = None, rule: str = "majority", vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per document and section: id, section, name, start, length, n_tokens, n_crossing.

    Sections are the \\n-split lines (name null), or the column ``sections``:
    an array of (name, start, end) in code points, disjoint. start and length
    are in code points; a null start or end is read as 0, ends beyond the text
    as its end. n_tokens is a double, whole unless the rule is split. Repeated
    rows are counted each; other columns are ignored, so names cannot clash.
    Tokens that lie in no section form a last row with section -1, if there
    are any. Null texts have no rows, empty ones a row for their empty line.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spans = F.lit(None).cast("array<struct<name:string,start:int,end:int>>") if sections is None else F.col(sections)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), spans.alias("spans")).where("text IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches):
        bpe = ByteBpe(vocabulary)
        for batch in batches:
            held = batch.column("spans").to_pylist() if sections is not None else None
            doc, section, name, first, size, tokens, cross = [], [], [], [], [], [], []
            for row, b in enumerate(byte_texts(batch.column("text"))):
                lengths = bpe.lengths[bpe.ids(b)]
                starts, ends = line_spans(b) if held is None else byte_spans(b, held[row] or [])
                order = np.argsort(starts, kind="stable") if held is not None else np.arange(len(starts))
                counts, crossing, outside = attribute(lengths, starts[order], ends[order], rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(b, dtype=np.uint8) & 0xC0) != 0x80)])
                n = len(starts)
                doc += [row] * n
                section += order.tolist()
                name += [None] * n if held is None else [held[row][i]["name"] for i in order]
                first += chars[starts[order]].tolist()
                size += (chars[ends[order]] - chars[starts[order]]).tolist()
                tokens += counts.tolist()
                cross += crossing.tolist()
                if outside > 1e-9:
                    for column, value in zip((doc, section, name, first, size, tokens, cross), (row, -1, None, None, None, outside, 0)):
                        column.append(value)
            ids = batch.column("id").take(pa.array(doc, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(section, pa.int32()), pa.array(name, pa.string()), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(tokens, pa.float64()), pa.array(cross, pa.int64())], names=["id", "section", "name", "start", "length", "n_tokens", "n_crossing"])

    return rows.mapInArrow(count, f"id {kind}, section int, name string, start long, length long, n_tokens double, n_crossing long").withColumnRenamed("id", id_col)


def field_sections(*columns: str, between: str = "\n") -> tuple:
    """(text, sections) columns that join fields into one text with a span for each; null fields are empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    spans, at = [], F.lit(0)
    for name, value in zip(columns, texts):
        end = at + F.length(value)
        spans.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + len(between)
    return F.concat_ws(between, *texts), F.array(*spans)
