"""Periodic runs of words: suffix trees, constant-time LCE and Lyndon roots.

A run is a stretch of words with smallest period q that is as long as
max(``least``, ``exponent`` * q) and that no neighbouring word extends with
that period. Every run has a Lyndon word of length q as root, and for one of
the two orders of the alphabet that root is the longest Lyndon word at its
place. So the candidates are the longest Lyndon words of all places under both
orders, 2n of them; each is extended to the right by the longest common
extension of the root's start and end, to the left by the same on the reversed
text. Extensions are depths of lowest common ancestors in two suffix trees,
built by Ukkonen's algorithm, read by a range minimum over their tours.

Trees are built where a run can be: every three words that stand in a run
stand there three times or more, so words outside of stretches of such triples
are in no run. A stretch is split until each of its triples occurs three times
in it. That loses no run and cuts none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_texts, with_columns

RUNS = T.StructType([
    T.StructField("periodic_runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed_text", T.StringType()),
])

#: words that are looked at for triples together; a longer document is looked at alone
CHUNK = 1 << 18
#: passes of splitting; a stretch that could be split further costs time, not results
PASSES = 32
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class SuffixTree:
    """Ukkonen's suffix tree of positive symbols and an end symbol 0, kept as tours of its leaves."""

    def __init__(self, symbols: Sequence[int]) -> None:
        text = [*symbols, 0]
        self.size = len(text)
        self._tours(text, *_ukkonen(text))

    def _tours(self, text, start, stop, kids) -> None:
        order, depths, back = [], [], []
        todo, low = [(0, 0, 0)], self.size
        while todo:
            node, above, depth = todo.pop()
            low = min(low, above)
            if kids[node] is None:
                order.append(self.size - depth)
                depths.append(low)
                low = self.size
            else:
                todo += [(k, depth, depth + stop[k] - start[k]) for _, k in sorted(kids[node].items(), reverse=True)]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            if kids[node] is None:
                back.append(self.size - depth)
            else:
                # the end stays the smallest symbol where the others' order is turned round
                todo += [(k, depth + stop[k] - start[k]) for s, k in sorted(kids[node].items()) if s]
                if 0 in kids[node]:
                    todo.append((kids[node][0], depth + 1))
        self.rank, self.back_rank = (np.empty(self.size, np.int64) for _ in range(2))
        self.rank[order] = self.back_rank[back] = np.arange(self.size)
        # depth of the lowest common ancestor of neighbouring leaves, and its minima over powers of two
        self.minima = [np.array(depths, np.int32)]
        while (step := 1 << (len(self.minima) - 1)) * 2 <= self.size:
            self.minima.append(np.minimum(self.minima[-1][:-step], self.minima[-1][step:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``i`` and ``j``, which differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for n in np.unique(level):
            own = level == n
            out[own] = np.minimum(self.minima[n][low[own]], self.minima[n][high[own] - (1 << int(n)) + 1])
        return out


def _ukkonen(text: Sequence[int]) -> tuple[list[int], list[int], list[dict[int, int] | None]]:
    """(start, stop, children) of each node's edge; node 0 is the root, leaves have no children."""
    size = len(text)
    start, stop, link = [0], [0], [0]
    kids: list[dict[int, int] | None] = [{}]
    node = edge = length = waiting = 0
    for at, symbol in enumerate(text):
        waiting += 1
        made = 0  # the inner node of this phase whose suffix link is open
        while waiting:
            if not length:
                edge = at
            first = text[edge]
            kid = kids[node].get(first)
            if kid is None:
                kids[node][first] = len(start)
                start.append(at), stop.append(size), link.append(0), kids.append(None)
                if made:
                    link[made], made = node, 0
            else:
                whole = stop[kid] - start[kid]
                if length >= whole:
                    edge, length, node = edge + whole, length - whole, kid
                    continue
                if text[start[kid] + length] == symbol:
                    length += 1
                    if made:
                        link[made] = node
                    break
                middle = len(start)
                start.append(start[kid]), stop.append(start[kid] + length), link.append(0), kids.append({symbol: middle + 1})
                start.append(at), stop.append(size), link.append(0), kids.append(None)
                kids[node][first] = middle
                start[kid] += length
                kids[middle][text[start[kid]]] = kid
                if made:
                    link[made] = middle
                made = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length, edge = length - 1, at - waiting + 1
    return start, stop, kids


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place but the last the next one whose suffix is smaller: the end of its longest Lyndon word."""
    ranks, stack, out = rank.tolist(), [], [0] * (len(rank) - 1)
    for i in range(len(ranks) - 1, -1, -1):
        while stack and ranks[stack[-1]] > ranks[i]:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: Sequence[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of positive symbols, by start, then period."""
    n = len(symbols)
    if n < max(least, 2):
        return []
    tree = SuffixTree(symbols)
    at = np.concatenate([np.arange(n)] * 2)
    end = np.concatenate([_next_smaller(tree.rank), _next_smaller(tree.back_rank)])
    right = tree.lce(at, end)
    del tree
    left = SuffixTree(symbols[::-1]).lce(n - at, n - end)
    start, period = at - left, end - at
    length = period + left + right
    fit = (length >= least) & (length >= exponent * period)
    return sorted(set(zip(start[fit].tolist(), length[fit].tolist(), period[fit].tolist())))


def _stretches(ids: np.ndarray, owner: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of stretches of words outside of which no run of exponent 4 is; ``owner`` tells documents apart."""
    if len(ids) < least:
        return []
    words = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        triple = words[:-2] * _MIX[0] ^ words[1:-1] * _MIX[1] ^ words[2:] * _MIX[2]
        at = np.flatnonzero(owner[:-2] == owner[2:])
        part = owner[at]
        for _ in range(PASSES):
            key = triple[at] ^ (part.astype(np.uint64) + np.uint64(1)) * _MIX[1]
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            keep = count[which] >= 3
            at, part, before = at[keep], part[keep], len(at)
            if not len(at):
                return []
            # a gap or a change of part begins a new one; parts with fewer triples than the shortest run go
            part = np.cumsum(np.r_[True, (np.diff(at) > 1) | (np.diff(part) != 0)])
            keep = np.bincount(part)[part] >= least - 2
            at, part = at[keep], part[keep]
            if len(at) in (0, before):
                break
    if not len(at):
        return []
    edges = np.flatnonzero(np.r_[True, np.diff(part) != 0, True])
    return [(int(at[a]), int(at[b - 1]) + 3) for a, b in zip(edges[:-1], edges[1:])]


def find_runs(documents: Sequence[list[bytes]], least: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs of exponent 4 and length ``least`` or more of each document's words."""
    known: dict[bytes, int] = {}
    sizes = [len(words) for words in documents]
    ids = np.array([known.setdefault(w, len(known) + 1) for words in documents for w in words], np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for start, end in _stretches(ids, owner, least):
        doc = int(owner[start])
        # symbols of one stretch are small numbers again
        _, symbols = np.unique(ids[start:end], return_inverse=True)
        shift = start - int(first[doc])
        found[doc] += [(s + shift, length, period) for s, length, period in runs_of((symbols + 1).tolist(), least)]
    return [sorted(runs) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def with_runs(docs: DataFrame, text: str = "text", least: int = 6) -> DataFrame:
    """Append periodic_runs (array of start, length, period, by start, then period) and collapsed_text.

    Words are separated by ASCII white space and numbered from 0. A run has
    four periods or more and ``least`` words (4 or more). A null text and one
    without words has no runs and an empty collapsed text. Texts do not move;
    repeated rows are treated alike. Columns of these names are replaced.

    A task holds the words of a chunk of documents, and the trees of one stretch of a document
    at a time, some 0.5 KB for each of its words.
    """
    if least < 6:
        raise ValueError("the shortest run has six words or more")

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            starts, lengths, periods, counts, texts = [], [], [], [0], []
            column, held, size = batch.column(text), [], 0
            for n in range(len(column)):
                # only the words of one chunk are there at a time
                held.append((byte_texts(column.slice(n, 1))[0] or b"").split())
                size += len(held[-1])
                if size >= CHUNK or n + 1 == len(column):
                    for words, runs in zip(held, find_runs(held, least)):
                        for s, length, period in runs:
                            starts.append(s), lengths.append(length), periods.append(period)
                        counts.append(len(starts))
                        texts.append(collapsed(words, runs).decode())
                    held, size = [], 0
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], names=["start", "length", "period"])
            return {"periodic_runs": pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values), "collapsed_text": pa.array(texts, pa.string())}

        return run

    return with_columns(docs, make, RUNS)
