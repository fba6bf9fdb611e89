"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words: a pattern is a window of benchmark words, a block is a
pair of words. For patterns of one length m, the shift table holds for every
block of any pattern how far the search may safely move (m-1 for a block in no
pattern), so most positions of a clean text are never looked at. Where the
shift is zero, the bucket of patterns that end with the block is narrowed by
the patterns' first block, and direct comparison confirms the occurrence.

Scale: the texts are scanned where they are, without a shuffle. The patterns
go to the tasks in blocks of ``block_patterns`` windows (a stated query set),
so the size of what one task holds is bounded however long the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, cut_lineage, with_columns

#: windows of ten words in one block: some 150 MB of Python objects in a task, at most
BLOCK_PATTERNS = 200_000

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 0x20 for c in range(256))


def words_of(b: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return b.translate(_TABLE).split() if b else []


class WuManber:
    """Search of word lists for word windows; ``add`` them, ``build``, ``find``."""

    def __init__(self) -> None:
        self.items: dict[tuple[bytes, ...], set] = defaultdict(set)
        self.sets: list[tuple[int, dict, dict]] = []

    def add(self, words: list[bytes], width: int, item) -> None:
        if words:
            width = min(width, len(words))
            for i in range(len(words) - width + 1):
                self.items[tuple(words[i : i + width])].add(item)

    def build(self) -> WuManber:
        by_length = defaultdict(list)
        for pattern in self.items:
            by_length[len(pattern)].append(pattern)
        self.sets = []
        for m, patterns in sorted(by_length.items()):
            block = min(2, m)
            shift: dict = {}
            buckets: dict = defaultdict(lambda: defaultdict(set))
            for p in patterns:
                for end in range(block, m + 1):
                    key = p[end - block : end]
                    if shift.get(key, m) > m - end:
                        shift[key] = m - end
                buckets[p[m - block :]][p[:block]].add(p)
            self.sets.append((m, shift, {k: dict(v) for k, v in buckets.items()}))
        return self

    def find(self, words: list[bytes]) -> Iterable[tuple[int, int, tuple[bytes, ...]]]:
        """(start, end, pattern) of every occurrence."""
        n = len(words)
        for m, shift, buckets in self.sets:
            block = min(2, m)
            default = m - block + 1
            skip = shift.get
            i = m  # the window is words[i - m : i]
            if block == 2:
                while i <= n:
                    move = skip((words[i - 2], words[i - 1]), default)
                    if move:
                        i += move
                        continue
                    for p in buckets[words[i - 2], words[i - 1]].get((words[i - m], words[i - m + 1]), ()):
                        if tuple(words[i - m : i]) == p:
                            yield i - m, i, p
                    i += 1
            else:
                for i, w in enumerate(words):
                    if (w,) in shift:
                        yield i, i + 1, (w,)


ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted, disjoint word spans that cover the same words."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_patterns: int):
    """Word lists of the benchmark items, streamed to the driver in bounded blocks."""
    block, size = [], 0
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    for row in items.toLocalIterator():
        words = words_of(bytes(row.t))
        for at in range(0, max(1, len(words) - width + 1), block_patterns):  # an item longer than a block is cut where windows start
            part = words[at : at + block_patterns + width - 1] if len(words) >= width else words
            if size and size + len(part) > block_patterns:
                yield block
                block, size = [], 0
            block.append((row.i, part))
            size += len(part)
    yield block


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """Append n_words, hit_spans (disjoint word spans [start, end)) and hit_items.

    Every window of ``width`` words of every item is searched; a shorter item
    is one window. Null texts have no words and no hits, as have wordless
    items; repeated items count once; ids are compared as strings and null ids
    are left out. Input columns named like the new ones are replaced.

    A benchmark of more than ``block_patterns`` windows is searched block by
    block, each in a stage of its own over the documents, which are written to
    the shared folder in between.
    """
    out, held = docs, None
    for number, block in enumerate(_blocks(benchmark, item_id, item_text, width, block_patterns)):
        if held is not None:
            # a stage for each block: a task holds the table of one
            out = cut_lineage(out)
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(block)

        def make(held=held, first=number == 0):
            search = WuManber()
            for item, words in held.value:
                search.add(words, width, item)
            search.build()

            def scan(batch: pa.RecordBatch) -> dict[str, pa.Array]:
                n_words, spans, items = [], [], []
                before = None if first else batch.select(["hit_spans", "hit_items"]).to_pylist()
                for at, b in enumerate(byte_texts(batch.column(text))):
                    words = words_of(b)
                    hits = [] if first else [tuple(s) for s in before[at]["hit_spans"]]
                    found = set() if first else set(before[at]["hit_items"])
                    for start, end, pattern in search.find(words):
                        hits.append((start, end))
                        found |= search.items[pattern]
                    n_words.append(len(words))
                    spans.append(merged(hits))
                    items.append(sorted(found))
                return {"n_words": pa.array(n_words, pa.int64()), "hit_spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "hit_items": pa.array(items, pa.list_(pa.string()))}

            return scan

        out = with_columns(out, make, ADDED)
    return out


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def n_hit():
    """Words inside hit spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def without_hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents with no occurrence of a benchmark window; columns unchanged."""
    new = [f.name for f in ADDED]
    clash = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in new}
    options["text"] = clash.get(options.get("text", "text"), options.get("text", "text"))
    found = with_hits(docs.withColumnsRenamed(clash), benchmark, **options).where(F.size("hit_items") == 0)
    return found.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
