"""Corpus language model by online logistic context mixing.

A text is lower-cased (A-Z), cut into words, and closed by one end token. Each
token is a series of bits: the path to its word in a Huffman tree, or the path
to an escape, if it is not among the ``max_words`` most frequent; an escaped
word is spelled, by Huffman paths of its bytes and a closing space. Three
predictors give a probability for each bit: one by the place in the tree, two
by contexts (for words: the previous token, and the previous two; for bytes:
the previous two, and the previous four). Their log-odds are mixed with
weights that a gate selects by how often the contexts were seen and how deep
in the tree the bit is; the mixed probability is refined by an adaptive map
from (gate, probability) to observed frequency. All bits together give the
log-probability and the bits per byte.

Online means that a bit is predicted before it is learned: what a bit of a
training text is predicted from are the counts of all other occurrences in the
training rows, never its own. So a text that occurs twice is known to the
model, one that occurs once is not, and the mixer learns on what it will meet.
Held-out texts are predicted from all training rows. A bit under contexts that
were never seen is left to the tree.

Scale: one pass over the texts counts words, one makes units (a token with its
two contexts), which are dealt to shards of about ``SHARD`` units by a hash of
the nearest context. A shard counts every bit under every context of its units
exactly, trains its own weights and map on all bits of its training units, and
scores its units, so the number of shards, and with it all that the model
gathers, follows the corpus without a ceiling. A nearest context with more
units than a quarter of a shard is spread by the context before it: its
predictor then has classes of the token before, more of them the larger the
corpus. Units of two contexts that are both so common that they could fill
shards are dealt by their texts as well. All of
that is decided by the training rows' counts, so held-out texts move no score
but their own. Scores return to the texts in blocks, as the units came. Equal
bits (level, context, node, value, and whether of training rows) are computed
once. Only the trees and the
head of the vocabulary (``max_words``) go to all tasks. Words beyond the head
are contexts by their hash, are spelled once each in shards of words, each with
a model of its own letters, and get their spelling and their base count by a join, so no word
is dropped at any size.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage

MAX_WORDS = 1 << 18
COUNTED = 1 << 23  # bytes of text whose words are counted at once
PIECE = 3 << 20  # bytes of text made into units at once
STEP = 1 << 13  # bits of one step of the mixer's learning
BLOCK = 1 << 16  # bits mixed at once
SHARD = 1 << 19  # units of one shard
SENT = 900_000  # units after which a sending task lets go of its block
PARTITIONS = 8192  # at most so many partitions; more shards share them
DEEP = (3, 9)  # depths from which on bits have other gates
INPUTS, DEPTHS, CELLS, FINE = 3, len(DEEP) + 1, 33, 257
LOG10 = math.log(10.0)
#: levels of a context by how often it was seen, up to 255 times
_NEAR = np.digitize(np.arange(256), (1, 2, 3, 5, 9, 17, 65, 255)).astype(np.int16)
_FAR = np.digitize(np.arange(256), (1, 2, 3, 5, 17)).astype(np.int16)
NEARS, FARS = int(_NEAR[-1]) + 1, int(_FAR[-1]) + 1
GATES = DEPTHS * NEARS * FARS


@dataclass(frozen=True)
class Vocabulary:
    """The head words (the end token is the empty word) with counts, and a tree."""

    words: list[bytes]
    counts: np.ndarray
    train_tokens: int
    distinct: int
    parent: np.ndarray
    leaves: np.ndarray  # counts of the leaves: words and the escape
    spread: np.ndarray  # into how many classes the units of each nearest context are dealt; the last is for all further ones
    often: np.ndarray  # how often training rows have each context, or more than that; the last is for all further ones
    shards: int
    shard: int


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, held) from rows (text, train): occurrences in training rows and in others; the empty word counts the texts."""

    def rows(texts: pa.Array, train: bool) -> pa.RecordBatch:
        words = words_of(texts).flatten().value_counts()
        n = pa.concat_arrays([words.field("counts"), pa.array([len(texts)], pa.int64())])
        columns = [pa.concat_arrays([words.field("values"), pa.array([b""], pa.binary())]), n, pa.array(np.zeros(len(n), dtype=np.int64))]
        return pa.RecordBatch.from_arrays(columns if train else [columns[0], columns[2], n], names=["word", "n", "held"])

    def count(batches):
        for batch in batches:
            for train in (True, False):
                texts = batch.filter(batch.column("train") if train else pc.invert(batch.column("train"))).column("text")
                for _, piece in in_pieces(texts, COUNTED):
                    yield rows(piece, train)

    counted = texts.select("text", "train").mapInArrow(count, "word binary, n long, held long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def huffman(counts: np.ndarray) -> np.ndarray:
    """Parent links: entry i is 2 * parent + bit of node i, leaves first; the root has -1."""
    n = len(counts)
    parent = np.full(max(1, 2 * n - 1), -1, dtype=np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j] = 2 * new, 2 * new + 1
        heapq.heappush(heap, (a + b, new))
        new += 1
    return parent


def paths(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, length, steps) of the leaves; a step is 2 * inner node + bit, inner nodes from 0."""
    n = (len(parent) + 1) // 2
    at, length = np.arange(n), np.zeros(n, dtype=np.int64)
    ups = []
    while (parent[at] >= 0).any():
        up = parent[at]
        live = up >= 0
        ups.append(np.where(live, up, -1))
        length += live
        at = np.where(live, up >> 1, at)
    offset = np.concatenate([[0], np.cumsum(length)])[:-1]
    steps = np.zeros(int(length.sum()), dtype=np.int64)
    for level, up in enumerate(ups):
        own = np.flatnonzero(up >= 0)
        steps[offset[own] + length[own] - 1 - level] = up[own] - 2 * n
    return offset, length, steps.astype(np.int32)


def _classes() -> Column:
    """A word's class by its count: exact counts up to 4,096, then 64 classes for each doubling."""
    octave = F.floor(F.log2("n"))
    return F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + 64 * (octave - 12) + F.floor((F.col("n") / F.pow(F.lit(2.0), octave) - 1) * 64)).cast("long")


def head(counts: DataFrame, max_words: int) -> list[tuple[bytes, int]]:
    """The ``max_words`` most frequent words seen twice or more, ties by word: (word, n).

    How many words there are in each class of counts (a few thousand at any
    size) tells which classes belong to the head as a whole; of the one that
    does so in part, the first words are taken.
    """
    named = counts.where((F.col("word") != F.lit(b"")) & (F.col("n") >= 2)).withColumn("class", _classes())
    room, whole, part = max_words, None, None
    for k, words in sorted(((r["class"], r.words) for r in named.groupBy("class").agg(F.count("*").alias("words")).collect()), reverse=True):
        if words > room:
            part = k
            break
        room, whole = room - words, k
    rows = named.where(F.col("class") >= whole).select("word", "n").collect() if whole is not None else []
    if part is not None and room:
        rows += named.where(F.col("class") == part).select("word", "n").orderBy(F.desc("n"), "word").limit(room).collect()
    return sorted(((bytes(r.word), int(r.n)) for r in rows), key=lambda r: (-r[1], r[0]))


def vocabulary(counts: DataFrame, max_words: int = MAX_WORDS, shard: int = SHARD) -> Vocabulary:
    """The head of ``counts`` and its tree, and into how many shards units go: all of it follows from training rows.

    Words seen once are never in the head: they escape and are spelled, which
    teaches the model how often new words come and what they look like.
    """
    seen = F.col("n") > 0
    total = counts.agg(F.sum("n").alias("n"), F.count(F.when(seen, 1)).alias("v"), F.max(F.when(F.col("word") == F.lit(b""), F.col("n"))).alias("ends")).first()
    tokens = int(total.n or 0)
    rows = head(counts, max_words)
    n = np.array([int(total.ends or 0), *(r[1] for r in rows)], dtype=np.int64)
    leaves = np.maximum(1, np.append(n, tokens - int(n.sum())))
    # nearest contexts: head words, the start of a text, and words beyond the head, none more frequent than the head's last
    near = np.concatenate([n, n[:1], n[-1:]])
    return Vocabulary([b"", *(r[0] for r in rows)], n, tokens, int(total.v or 0), huffman(leaves), leaves, np.maximum(1, -(-4 * near // shard)), near, max(1, -(-tokens // shard)), shard)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the two bytes before, the two before them, byte, word number) of the words' bytes and closing spaces."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    a = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    m = len(a) - 1
    at = np.repeat(np.arange(len(words)), size)
    place = np.arange(m) - (np.cumsum(size) - size)[at]
    b1, b2, b3, b4 = (np.where(place >= back, np.concatenate([np.zeros(back, dtype=np.int64), a[: m - back]])[:m], 0) for back in range(4))
    return b1 | b2 << 8, b3 | b4 << 8, a[1:], at


def spellings(words: list[bytes], train: np.ndarray) -> np.ndarray:
    """log10 probability of each word's letters and closing space, by a model of the training words' letters.

    Every byte has a leaf, so a letter that no training word has costs much, not everything.
    """
    near, before, symbol, at = spelled(words)
    leaves = np.bincount(symbol[train[at]], minlength=256) + 1
    letters = Coder(Vocabulary([], leaves, int(leaves.sum()), 256, huffman(leaves), leaves, np.ones(1, dtype=np.int64), np.ones(1, dtype=np.int64), 1, SHARD))
    return np.bincount(at, shard_scores(letters, near, before, symbol, train[at]), len(words))


class Coder:
    """A tree's paths and the dealing of contexts. Build one in each task."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.escape = len(v.words)
        self.spread, self.shards = v.spread, v.shards
        self.offset, self.length, self.steps = paths(v.parent)
        n = len(self.length)
        size = [*map(int, v.leaves), *[0] * (n - 1)]
        ones = np.zeros(max(1, n - 1), dtype=np.float64)
        for i, up in enumerate(v.parent.tolist()):
            if up >= 0:
                size[up >> 1] += size[i]
                if up & 1:
                    ones[(up >> 1) - n] = size[i]
        self.size = np.array(size[n:] or [1], dtype=np.float64)
        # the tree is built by these counts, so that leaving an occurrence out of a node would tell its bit
        self.odds = np.log(np.maximum(ones, 1) / np.maximum(self.size - ones, 1)).astype(np.float32)
        code = np.zeros(n, dtype=np.uint64)
        for d in range(min(64, int(self.length.max(initial=0)))):
            own = np.flatnonzero(self.length > d)
            code[own] |= (self.steps[self.offset[own] + d] & 1).astype(np.uint64) << np.uint64(63 - d)
        self.code = code  # no path is longer: that would take 2^44 tokens
        self.order = np.empty(n, dtype=np.uint64)  # leaves from left to right: the leaves under a node are neighbours
        self.order[np.argsort(code, kind="stable")] = np.arange(n, dtype=np.uint64)
        self.order_bits = max(1, (n - 1).bit_length())

    @cached_property
    def head(self) -> pa.Array:
        return pa.array(self.v.words, pa.binary())

    def units(self, texts: pa.ListArray | list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
        """(nearest context, the one before it, symbol, text number) of all tokens, and each text's words beyond the head."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.list_(pa.binary()))
        words = pc.list_value_length(texts).to_numpy().astype(np.int64)
        ends = np.cumsum(words + 1) - 1
        flat = texts.flatten()
        own = pc.fill_null(pc.index_in(flat, value_set=self.head), -1).to_numpy().astype(np.int64)
        tail = np.flatnonzero(own < 0)
        beyond = flat.take(pa.array(tail))
        # words beyond the head have a negative number that their hash decides
        own[tail] = [~(xxhash.xxh64_intdigest(w) >> 2) for w in beyond.to_pylist()]
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(tail, np.concatenate([[0], np.cumsum(words)])), pa.int32()), beyond)
        inside = np.ones(len(flat) + len(texts), dtype=bool)
        inside[ends] = False
        s = np.zeros(len(inside), dtype=np.int64)
        s[inside] = own
        at = np.repeat(np.arange(len(texts)), words + 1)
        context = np.where(s < 0, self.escape + 1 + ~s % ((1 << 32) - self.escape - 1), s)
        before, two = np.empty_like(s), np.empty_like(s)
        before[1:], two[2:] = context[:-1], context[:-2]
        first = np.concatenate([[0], ends[:-1] + 1])[: len(texts)]
        second = first[words > 0] + 1
        before[first], two[second] = self.escape, self.escape
        # the start of a text has nothing before it: its classes are dealt by the text
        classes = int(self.spread[self.escape])
        two[first] = [xxhash.xxh64_intdigest(x) % classes for x in pc.binary_join(texts, b" ").to_pylist()] if classes > 1 else 0
        return before, two, np.where(s < 0, self.escape, s), at, rare

    def shard(self, near: np.ndarray, before: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The shard of each unit; ``owner`` is a hash of its text.

        Where both contexts are so common that units of the two together could
        fill shards, they are dealt by their texts too: by how often training
        rows have the rarer of the two, so that all senders deal alike.
        """
        last = len(self.spread) - 1
        part = _mixed(before) % self.spread[np.minimum(near, last)].astype(np.uint64)
        rarer = np.minimum(self.v.often[np.minimum(near, last)], self.v.often[np.minimum(before, last)])
        split = np.flatnonzero(rarer > 4 * self.v.shard)
        if len(split):
            ways = (-(-rarer[split] // (4 * self.v.shard))).astype(np.uint64)
            part[split] = _mixed(part[split] ^ (owner[split] % ways + np.uint64(1)) << np.uint64(20)) & np.uint64(0xFFFFFFFF)
        return (_mixed(near.astype(np.uint64) ^ part << np.uint64(32)) % np.uint64(self.shards)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers below 2^32 as compressed byte planes; the first is sorted, and its steps are sent.

    Units have four: contexts, symbol, and twice the text's place in its block
    with 1 for training. Their scores have two: place and score.
    """
    columns = [np.diff(columns[0].astype(np.int64), prepend=0), *columns[1:]]
    raw = b"".join(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in columns)
    return pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, n: int, columns: int = 4) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 4 * columns * n, "zstd", asbytes=True), dtype=np.uint8).reshape(columns, 4, n)
    out = [np.ascontiguousarray(x.T).view("<u4").ravel() for x in planes]
    out[0] = np.cumsum(out[0], dtype=np.int64)
    return out


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of the groups of equal keys in that order, group of each place in it)."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), dtype=bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    return order, np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - np.int32(1)


def _passing(coder: Coder, context: np.ndarray, symbol: np.ndarray, weight: np.ndarray, train: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Depth after depth: (entry, whether in training rows, its run, its bit, whether others have seen its context) and (first entry, occurrences, ones) of the runs.

    Entries are sorted by context and the symbol's place among the tree's
    leaves, so that those passing one node under one context are neighbours, a
    run, and their counts are sums over it. An entry of training rows does not
    count one occurrence of its own as seen by others.
    """
    code, length = coder.code[symbol], coder.length[symbol].astype(np.int16)
    # how many bits of its path an entry shares with the one before it; -1: not even the context
    shared = np.full(len(symbol), -1, dtype=np.int8)
    other = code[1:] ^ code[:-1]
    other &= ~(other >> np.uint64(1))  # the highest bit stays, and no rounding can raise it
    shared[1:] = np.where(context[1:] == context[:-1], 64 - np.frexp(other.astype(np.float64))[1], -1)
    own, w, t = np.arange(len(symbol), dtype=np.int32), weight.astype(np.int32), train.astype(np.int32)
    keep = length > 0
    depth = 0
    while keep.any():
        if not keep.all():
            own, code, length, shared, w, t = (x[keep] for x in (own, code, length, shared, w, t))
        new = shared < depth
        starts, run = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - np.int32(1)
        bit = (code & np.uint64(1 << 63 - depth)) != 0
        seen, ones = np.add.reduceat(w, starts, dtype=np.int32), np.add.reduceat(w * bit, starts, dtype=np.int32)
        known = seen[run] > t
        # one is left if there are two, or one and an entry that is not of training rows
        live = (seen > 0) & (seen + np.diff(starts, append=len(own)) > 2)
        yield own, t, run, bit, known, own[starts], seen, ones
        keep = live[run]
        depth += 1
        keep &= length > depth


def seen_bits(coder: Coder, context: np.ndarray, symbol: np.ndarray, weight: np.ndarray, train: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Depth after depth: (entry, node, bit, zeros, ones) of the bits whose context was seen by others."""
    for depth, (own, _, run, bit, known, _, seen, ones) in enumerate(_passing(coder, context, symbol, weight, train)):
        own, run, bit = own[known], run[known], bit[known].astype(np.int8)
        zeros, ones = (seen - ones)[run] - train[own] * (1 - bit), ones[run] - train[own] * bit
        yield own, coder.steps[coder.offset[symbol[own]] + depth] >> 1, bit, zeros, ones


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)), dtype=np.float32)


class Mixer:
    """Gated weights over the predictors' log-odds, and the adaptive map behind them."""

    def __init__(self) -> None:
        far = np.arange(GATES) // NEARS % FARS > 0
        self.weights = np.stack([np.where(far, 0.1, 0.3), np.where(far, 0.4, 0.7), np.where(far, 0.6, 0.0), np.zeros(GATES)]).astype(np.float32)
        self.bend = np.tile(20 * np.eye(INPUTS + 1), (GATES, 1, 1))
        self.ones, self.seen = np.zeros(GATES * CELLS), np.zeros(GATES * CELLS)

    @staticmethod
    def gate(depth: int, near: np.ndarray, far: np.ndarray | int = 0) -> np.ndarray:
        """By the depth of the bit and how often the contexts were seen."""
        return _NEAR[np.minimum(near, 255)] + _FAR[np.minimum(far, 255)] * np.int16(NEARS) + np.int16(sum(depth >= x for x in DEEP) * NEARS * FARS)

    def mixed(self, gate: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
        mix = self.weights[INPUTS][gate]
        for w, x in zip(self.weights, odds):
            mix += w[gate] * x
        return np.clip(mix, -8, 8)

    def learn(self, gate: np.ndarray, odds: list[np.ndarray], bit: np.ndarray, weight: np.ndarray) -> None:
        """All bits, online: each gate takes its own in steps, and every step has bits from the first to the last."""
        if not len(bit):
            return
        order = np.argsort(gate, kind="stable")
        ends = np.cumsum(np.bincount(gate, minlength=GATES)).tolist()
        cuts = [(g, a, b, max(-(-(b - a) // STEP), min(4, -(-(b - a) // 64)))) for g, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
        order = np.concatenate([order[a + k : b : steps] for _, a, b, steps in cuts for k in range(steps)])
        x = np.ones((len(odds) + 1, len(order)), dtype=np.float32)  # the last row is the bias
        for i, column in enumerate(odds):
            x[i] = column[order]
        rows = [*range(len(odds)), INPUTS]
        gate, bit, weight = gate[order], bit[order].astype(np.float32), weight[order].astype(np.float32)
        mix = np.empty(len(order), dtype=np.float32)
        for g, a, b, steps in cuts:
            w, bend = self.weights[rows, g], self.bend[g][np.ix_(rows, rows)]
            size = [(b - a - k + steps - 1) // steps for k in range(steps)]
            for n in size:
                own, a = slice(a, a + n), a + n
                now = mix[own] = np.clip(w @ x[:, own], -8, 8)
                p = 1 / (1 + np.exp(-now))
                bend += (x[:, own] * (p * (1 - p) * weight[own])) @ x[:, own].T
                w += np.linalg.solve(bend, x[:, own] @ ((bit[own] - p) * weight[own])).astype(np.float32)
            self.weights[rows, g], self.bend[g][np.ix_(rows, rows)] = w, bend
        place = np.minimum((mix + 8) * 2, np.float32(CELLS - 1.001))
        cell = place.astype(np.int32)
        part = (place - cell) * weight
        cell += gate.astype(np.int32) * CELLS
        for at, share in ((0, weight - part), (1, part)):
            self.ones += np.bincount(cell + at, share * bit, len(self.ones))
            self.seen += np.bincount(cell + at, share, len(self.seen))

    def settle(self) -> None:
        """The table of log10 p by gate, sixteenth of log-odds and bit: half from the mix, half from the map."""
        centre = 1 / (1 + np.exp(8 - np.arange(CELLS) / 2))
        refined = (self.ones + 30 * np.tile(centre, GATES)) / (self.seen + 30)
        mix = np.arange(FINE) / 16 - 8
        low = np.minimum((mix + 8) * 2, CELLS - 1.001).astype(np.int64)
        part = (mix + 8) * 2 - low
        by_gate = refined.reshape(GATES, CELLS)
        p = np.clip(0.5 / (1 + np.exp(-mix)) + 0.5 * (by_gate[:, low] * (1 - part) + by_gate[:, low + 1] * part), 1e-5, 1 - 1e-5)
        self.table = np.log10(np.stack([1 - p, p], axis=-1)).astype(np.float32).ravel()

    def log10(self, gate: np.ndarray, odds: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        out = np.empty(len(bit), dtype=np.float32)
        for at in range(0, len(bit), BLOCK):
            own = slice(at, at + BLOCK)
            cell = (self.mixed(gate[own], [x[own] for x in odds]) * 16 + 128.5).astype(np.int32)
            out[own] = self.table[(gate[own].astype(np.int32) * FINE + cell) * 2 + bit[own]]
        return out


def _level(coder: Coder, contexts: np.ndarray, symbol: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, symbol, train), sorted by context and leaf: (a row of each, number of rows, entry of each row)."""
    key = contexts.astype(np.uint64) << np.uint64(coder.order_bits + 1) | coder.order[symbol] << np.uint64(1) | train.astype(np.uint64)
    order, starts, ranked = _groups(key)
    entry = np.empty(len(key), dtype=np.int32)
    entry[order] = ranked
    return order[starts], np.diff(np.append(starts, len(key))).astype(np.int32), entry


def shard_scores(coder: Coder, near: np.ndarray, before: np.ndarray, symbol: np.ndarray, train: np.ndarray) -> np.ndarray:
    """log10 probability of each unit of a shard, by a model of this shard's units.

    Two levels of entries: distinct (nearest context, symbol, train), and those
    with both contexts. A bit is mixed on the last level whose context was seen
    there; a path goes on with what is left of it on the level before, and
    behind that with the tree. The mixer learns every bit of every training
    unit of the shard: those under one context, at one node and of one value
    have the same counts, so they are one bit with a weight. Gates of bits at
    other depths are others, so a few depths at a time are learned and scored.
    """
    if not len(near):
        return np.zeros(0)
    by_pair, _, pair = _groups(near.astype(np.uint64) << np.uint64(32) | before.astype(np.uint64))
    near, symbol, train = near[by_pair], symbol[by_pair], train[by_pair].astype(np.int32)
    fresh = np.ones(len(near), dtype=bool)
    np.not_equal(near[1:], near[:-1], out=fresh[1:])
    context = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    rows, size, entry = _level(coder, pair, symbol, train)
    own, _, up = _level(coder, context[rows], symbol[rows], train[rows])
    levels = [(context[rows[own]], rows[own], np.bincount(up, size, len(own)).astype(np.int32)), (pair[rows], rows, size)]
    value = [np.zeros(len(own)) for _, own, _ in levels]
    until = np.zeros(len(own), dtype=np.int32)  # depth at which a path leaves the first level
    said = np.zeros(len(rows))  # what the first level says of a path up to where it leaves the last
    mixer = Mixer()
    flows = [_passing(coder, c, symbol[own], size * train[own], train[own]) for c, own, size in levels]
    waiting: list[_Bits] = []
    run_of = np.zeros(len(own), dtype=np.int32)
    depth = 0
    while True:
        more = False
        for level, (flow, (_, entries, _)) in enumerate(zip(flows, levels)):
            found = next(flow, None)
            if found is None:  # a context seen here is seen on the levels before
                break
            more = True
            own, learned, run, bit, known, first, seen, ones = found
            if level:
                above = run_of[up[first]]
            else:
                run_of[own] = run
                tree = coder.odds[coder.steps[coder.offset[symbol[entries[first]]] + depth] >> 1]
            # equal bits: of one run and value, learned from or not
            case = run + (learned * np.int32(2) + bit) * np.int32(len(first))
            if not known.all():
                own, case = own[known], case[known]
            there = np.zeros(4 * len(first), dtype=bool)
            there[case] = True
            of = np.flatnonzero(there)
            slot = np.cumsum(there, dtype=np.int32) - np.int32(1)
            cuts = np.searchsorted(of, np.arange(5) * len(first))
            of %= len(first)
            counts = [(seen - ones)[of], ones[of]]
            weight = np.concatenate([counts[0][cuts[2] : cuts[3]], counts[1][cuts[3] :]])
            if level:
                odds, pairs = [tree[above[of]]], [[x[above[of]] for x in total], counts]
            else:
                odds, pairs, total = [tree[of]], [counts], [seen - ones, ones]
            for zero, one in pairs:  # not its own occurrence
                zero[cuts[2] : cuts[3]] -= 1
                one[cuts[3] :] -= 1
            odds += [stretched(*x) for x in pairs]
            gate = Mixer.gate(depth, *(x[0] + x[1] for x in pairs))
            bits = np.repeat(np.array([0, 1, 0, 1], dtype=np.int8), np.diff(cuts))
            waiting.append(_Bits(level, depth, own, slot[case], bits, gate, odds, int(cuts[2]), weight))
        depth += 1
        if waiting and (not more or depth in DEEP):  # the gates of deeper bits are others
            for level in range(len(levels)):
                _train(mixer, [x for x in waiting if x.level == level])
            mixer.settle()
            for x in waiting:
                value[x.level][x.own] += mixer.log10(x.gate, x.odds, x.bit)[x.item]
                if x.level:
                    said[x.own] = value[0][up[x.own]]
                else:
                    until[x.own] = x.depth + 1
            waiting = []
        if not more:
            break
    s = symbol[levels[0][1]]
    stopped = np.flatnonzero(until < coder.length[s])
    node = coder.steps[coder.offset[s[stopped]] + until[stopped]] >> 1
    value[0][stopped] += np.log10(coder.v.leaves[s[stopped]] / coder.size[node])
    # behind the last level a path goes on with what is left of it on the level before
    out = np.empty(len(near))
    out[by_pair] = (value[1] + value[0][up] - said)[entry]
    return out


@dataclass
class _Bits:
    """The bits of a level at one depth, equal ones once: those of held-out rows, then those to learn from."""

    level: int
    depth: int
    own: np.ndarray  # the entries that have them
    item: np.ndarray  # which of the bits each entry has
    bit: np.ndarray
    gate: np.ndarray
    odds: list[np.ndarray]
    learned: int  # the first bit to learn from
    weight: np.ndarray  # how often training rows have each of those


def _train(mixer: Mixer, depths: list[_Bits]) -> None:
    """Learn every bit that training rows have at some depths of a level."""
    if depths:
        odds = [np.concatenate(x) for x in zip(*([o[d.learned :] for o in d.odds] for d in depths))]
        mixer.learn(np.concatenate([d.gate[d.learned :] for d in depths]), odds, np.concatenate([d.bit[d.learned :] for d in depths]), np.concatenate([d.weight for d in depths]))


#: behind the columns of what is scored (texts or words): the block and the place in it, or a shard's units of that block
DEALT = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("shard", T.IntegerType()),
    T.StructField("n", T.IntegerType()), T.StructField("units", T.BinaryType()),
])


class _Sender:
    """Units of one sending task; rows and units of a block leave together."""

    def __init__(self, coder: Coder, arrow: pa.Schema) -> None:
        self.coder, self.arrow = coder, arrow
        self.task, self.part = TaskContext.get().partitionId(), 0
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = self.rows = 0

    @property
    def block(self) -> int:
        return self.task << 32 | self.part

    def add(self, near: np.ndarray, before: np.ndarray, symbol: np.ndarray, place: np.ndarray, train: np.ndarray, owner: np.ndarray) -> None:
        """Units of further rows; ``place`` counts from the first of them, ``owner`` has a hash for each row."""
        to = self.coder.shard(near, before, owner[place]).astype("<u4")
        self.waiting.append((near.astype("<u4"), before.astype("<u4"), symbol.astype("<u4"), ((place + self.rows) * 2 + train[place]).astype("<u4"), to))
        self.size += len(near)
        self.rows += len(train)

    def places(self, n: int) -> dict[str, pa.Array]:
        """Block and places of the ``n`` rows that ``add`` gets next."""
        return {"block": pa.array(np.full(n, self.block), pa.int64()), "place": pa.array(np.arange(self.rows, self.rows + n), pa.int32())}

    def batch(self, columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in self.arrow], schema=self.arrow)

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.size < least:
            return
        *columns, to = (np.concatenate(x) for x in zip(*self.waiting))
        order = np.argsort(to.astype(np.uint64) << np.uint64(32) | columns[0])
        columns, to = [x[order] for x in columns], to[order]
        keys, starts = np.unique(to, return_index=True)
        ends = np.append(starts[1:], len(to))
        for at in range(0, len(keys), 256):
            some = [(int(k), int(e - s), packed([x[s:e] for x in columns])) for k, s, e in zip(keys[at : at + 256], starts[at : at + 256], ends[at : at + 256])]
            got = {"shard": [x[0] for x in some], "n": [x[1] for x in some], "units": [x[2] for x in some]}
            yield self.batch({"block": pa.array([self.block] * len(some), pa.int64()), **{k: pa.array(x, self.arrow.field(k).type) for k, x in got.items()}}, len(some))
        self.waiting, self.size, self.rows, self.part = [], 0, 0, self.part + 1


def scored(source: DataFrame, send: Callable, info: T.StructType, held: _Held, shards: int) -> DataFrame:
    """Rows of ``info`` with block, place and score: what ``send`` makes of ``source``, dealt to the shards and back.

    Rows without units keep the score 0; no rows give none. Shards beyond
    ``PARTITIONS`` follow each other in a partition, one held at a time.
    """
    schema = T.StructType([*info, *DEALT])
    arrow = to_arrow_schema(schema)

    def sent(batches):
        yield from send(_Sender(held.coder, arrow), batches)

    def in_shards(batches):
        key, waiting = None, []

        def out():
            columns = [np.concatenate(x) for x in zip(*(unpacked(r["units"], r["n"]) for r in waiting))]
            near, before, symbol, mark = columns
            value = shard_scores(held.coder, near, before, symbol.astype(np.int64), (mark & 1).astype(bool))
            at = 0
            got: list[list] = [[], [], []]
            for r in waiting:
                own = slice(at, at + r["n"])
                place, back = np.unique(mark[own] >> 1, return_inverse=True)
                got[0].append(r["block"])
                got[1].append(len(place))
                got[2].append(packed([place, np.bincount(back, value[own], len(place)).astype("<f4").view("<u4")]))
                at += r["n"]
            columns = {"block": pa.array(got[0], pa.int64()), "n": pa.array(got[1], pa.int32()), "units": pa.array(got[2], pa.binary())}
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(waiting), f.type)) for f in arrow], schema=arrow)

        for batch in batches:
            of_units = batch.column("shard").is_valid()
            yield pa.RecordBatch.from_arrays(batch.filter(pc.invert(of_units)).columns, schema=arrow)
            for r in batch.filter(of_units).select(["block", "shard", "n", "units"]).to_pylist():
                if r["shard"] != key:
                    if waiting:
                        yield out()
                    key, waiting = r["shard"], []
                waiting.append(r)
        if waiting:
            yield out()

    final = to_arrow_schema(T.StructType([*info, *DEALT[:2], T.StructField("score", T.DoubleType())]))

    def summed(batches):
        block, waiting = None, []

        def out():
            rows = pa.Table.from_batches(waiting)
            own = rows.filter(rows["place"].is_valid())
            place = own["place"].to_numpy()
            sums = np.zeros(int(place.max(initial=-1)) + 1)
            for n, data in zip(*(rows.filter(rows["units"].is_valid())[c].to_pylist() for c in ("n", "units"))):
                at, score = unpacked(data, n, 2)
                sums[at] += score.view("<f4")
            columns = [own[f.name] if f.name != "score" else pa.chunked_array([pa.array(sums[place], pa.float64())]) for f in final]
            return pa.Table.from_arrays(columns, schema=final).to_batches()

        for batch in batches:
            keys = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if keys[a] != block:
                        if waiting:
                            yield from out()
                        block, waiting = keys[a], []
                    waiting.append(pa.RecordBatch.from_arrays(batch.slice(a, b - a).columns, schema=arrow))
        if waiting:
            yield from out()

    dealt = source.mapInArrow(sent, schema).repartition(min(shards, PARTITIONS), F.coalesce("shard", F.hash("block")))
    back = dealt.sortWithinPartitions("shard", "block").mapInArrow(in_shards, schema)
    return back.repartition("block").sortWithinPartitions("block").mapInArrow(summed, T.StructType([*info, *DEALT[:2], T.StructField("score", T.DoubleType())]))


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of each text, lower-cased; null has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # nothing is before the first space or behind the last
    offsets = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    sizes = pc.list_value_length(split).to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets[np.concatenate([[0], np.cumsum(sizes)])], pa.int32()), flat.filter(real).cast(pa.binary()))


def in_pieces(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts, each ended by the one that brings the bytes to a multiple of ``size``: (first row, texts)."""
    so_far = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    cuts = (np.flatnonzero(np.diff(so_far // size, prepend=0)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if b > a:
            yield a, texts.slice(a, b - a)


def spelled_words(counts: DataFrame, v: Vocabulary, shard: int) -> DataFrame:
    """(word, train, n, spelling) of the words beyond the head: log10 probability of each one's letters.

    A word of both training and other rows has a row for each: ``train`` says
    whether its own occurrence is left out of the counts. Every word counts
    once, however often it occurs: what is learned is how new words look.
    """
    last = F.lit(v.words[-1])
    tail = counts.where((F.col("word") != F.lit(b"")) & ((F.col("n") < int(v.counts[-1])) | ((F.col("n") == int(v.counts[-1])) & (F.col("word") > last))) if len(v.words) > 1 else F.col("word") != F.lit(b""))
    # training words alone decide into how many shards the words go
    letters = tail.where("n > 0").agg(F.sum(F.length("word") + 1)).first()[0] or 0
    uses = tail.select("word", "n", F.explode(F.array_compact(F.array(F.when(F.col("n") > 0, True), F.when(F.col("held") > 0, False)))).alias("train"))
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("train", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("spelling", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def spell(batches):
        rows = pa.Table.from_batches(got) if (got := list(batches)) else None
        if rows is not None and rows.num_rows:
            score = spellings(rows["word"].to_pylist(), rows["train"].to_numpy().astype(bool))
            yield from pa.Table.from_arrays([rows["word"], rows["train"], rows["n"], pa.chunked_array([pa.array(score)])], schema=arrow).to_batches()

    return uses.repartition(max(1, -(-int(letters) // shard)), F.xxhash64("word")).sortWithinPartitions("word", "train").mapInArrow(spell, schema)


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS, shard: int = SHARD) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``training`` selects the rows to learn from (null selects nothing). Null
    and empty texts are the end token alone; their bits per byte are null.
    Repeated rows are scored each. With no training rows every token costs
    the same and the contexts say nothing. Other columns are ignored, so names
    cannot clash. ``shard`` is the size of the model's parts in units, not of
    the model; ``max_words`` bounds what is broadcast, not what is learned.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    counts = cut_lineage(word_counts(texts))
    v = vocabulary(counts, max_words, shard)
    held = _sent_to_all(docs.sparkSession, v)
    below = v.train_tokens + 0.5 * (v.distinct + 1)
    of_texts = T.StructType([
        T.StructField("id", texts.schema["id"].dataType), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("rare", T.StringType()),
    ])

    def send(sender: _Sender, batches):
        base = np.append(np.log10((v_counts() + 0.5) / below), 0.0)
        known = np.append(v_counts() > 0, False)
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False)
            for start, run in in_pieces(batch.column("text"), PIECE):
                near, before, s, at, rare = sender.coder.units(words_of(run))
                m = len(run)
                joined = pc.binary_join(rare, b" ").cast(pa.string())
                got = {
                    "id": batch.column("id").slice(start, m), "train": batch.column("train").slice(start, m), "n_tokens": pa.array(np.bincount(at, minlength=m), pa.int64()),
                    "known": pa.array(np.bincount(at, known[s], m).astype(np.int64)), "base": pa.array(np.bincount(at, base[s], m)),
                    "n_bytes": pc.fill_null(pc.binary_length(run), 0).cast(pa.int64()), "rare": pc.if_else(pc.greater(pc.list_value_length(rare), 0), joined, pa.scalar(None, pa.string())),
                }
                yield sender.batch(sender.places(m) | got, m)
                owner = np.array([xxhash.xxh64_intdigest(str(i)) for i in got["id"].to_pylist()], np.uint64)
                sender.add(near, before, s, at, train[start : start + m], owner)
                yield from sender.flush(SENT)
        yield from sender.flush()

    def v_counts() -> np.ndarray:
        return held.coder.v.counts

    rows = cut_lineage(scored(texts, send, of_texts, held, v.shards))
    key = ["block", "place"]
    rare = rows.select(*key, "train", F.explode(F.split("rare", " ")).alias("word")).withColumn("word", F.col("word").cast("binary"))
    looked = rare.join(spelled_words(counts, v, shard), ["word", "train"])
    tail = looked.groupBy(*key).agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("tail_known"), F.sum(F.log10((F.col("n") + 0.5) / below)).alias("tail_base"), F.sum("spelling").alias("tail_score")
    )
    score = F.col("score") + F.coalesce("tail_score", F.lit(0.0))
    return rows.drop("rare").join(tail, key, "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(v.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), score.alias("score"), "n_bytes",
        F.when(F.col("n_bytes") > 0, -score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


class _Held:
    """A broadcast vocabulary; plain values travel, so executors need no installed copy."""

    def __init__(self, broadcast, key: str) -> None:
        self.broadcast, self.key = broadcast, key

    def __reduce__(self):
        return _Held, (self.broadcast, self.key)

    @property
    def coder(self) -> Coder:
        """Built once in each worker process; the last two (of words and of letters) are held."""
        if self.key not in _CODERS:
            while len(_CODERS) > 1:
                _CODERS.pop(next(iter(_CODERS)))
            _CODERS[self.key] = Coder(Vocabulary(**self.broadcast.value))
        return _CODERS[self.key]


_CODERS: dict[str, Coder] = {}


def _sent_to_all(spark: SparkSession, v: Vocabulary) -> _Held:
    return _Held(spark.sparkContext.broadcast(v.__dict__), uuid.uuid4().hex)
