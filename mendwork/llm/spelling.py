"""Spelling variants: words one edit apart, compared as code-point matrices.

Two words are near if they differ by one inserted, deleted or replaced code
point, that is, if their common prefix and suffix together reach the longer
length less one. The shorter word is thought of as three pieces; one edit
leaves two of them alone, so near words share the first two, the outer two or
the last two. Each such pair of pieces is a block; words of a block, or of two
tiles of a large block, are compared densely, column by column of two padded
matrices, one aligned left and one right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

#: words of a tile; a larger block is compared by pairs of its tiles
TILE = 1024
#: groups below this size are compared as lists of pairs, larger ones as matrices
DENSE = 48
#: pairs compared at a time
PAIRS = 1 << 19

NEAR = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())])


def _pieces(m: Column) -> tuple[Column, Column, Column]:
    """Lengths of the three pieces of a word of ``m`` code points."""
    return F.floor((m + 2) / 3).cast("int"), F.floor(m / 3).cast("int"), F.floor((m + 1) / 3).cast("int")


def _blocks(words: DataFrame) -> DataFrame:
    """(key, m, side, word, n): a word under each pair of pieces, as the shorter word and as one longer by one."""
    size = F.length("word")
    rows = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("m")).where("m > 0")
    a, b, c = _pieces(F.col("m"))
    head, tail = lambda k: F.left(F.col("word"), k), lambda k: F.right(F.col("word"), k)
    parts = [F.struct(F.lit(n).alias("side"), *[x.alias(y) for x, y in zip(ends, ("head", "tail"))]) for n, ends in enumerate(((head(a + b), F.lit("")), (head(a), tail(c)), (F.lit(""), tail(b + c))))]
    long = rows.select("word", "n", "m", F.explode(F.array(*parts)).alias("p"))
    return long.select(F.xxhash64("m", "p.side", "p.head", "p.tail").alias("key"), "m", "p.side", "word", "n")


def near_pairs(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n, near, near_n): every pair of near words, once in each direction.

    ``words`` has distinct non-null words and their counts n. A block of more
    than ``tile`` words is dealt to pairs of tiles by a hash of the word, so a
    task holds two tiles at a time; a word meets its near word in one block
    and one tile pair only, whichever of the blocks they share come first.
    """
    rows = _blocks(words)
    sizes = rows.groupBy("key").agg(F.count("*").alias("_k")).where("_k > 1")
    dealt = rows.join(sizes, "key").withColumn("_tiles", F.ceil(F.col("_k") / tile).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("_tiles")).cast("int")
    spread = dealt.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    low, high = F.least("own", "_other"), F.greatest("own", "_other")
    tiled = spread.select("key", (low.cast("long") * F.col("_tiles") + high).alias("tile"), (low == high).alias("alone"), "own", "m", "side", "word", "n")
    # a group's rows come one after the other, whatever its size
    return tiled.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_compare_groups, NEAR)


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = [batch.column(c).to_numpy() for c in ("key", "tile")]
        last = np.flatnonzero((group[0] != group[0][-1]) | (group[1] != group[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        # groups that end in this batch are complete
        if cut or (held and (held[-1].column("key")[-1] != batch.column("key")[0] or held[-1].column("tile")[-1] != batch.column("tile")[0])):
            yield from _compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _compare(pa.Table.from_batches(held))


def _matrices(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, padded with 0 to the right and, in the second matrix, to the left."""
    width = int(sizes.max())
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.zeros((width, len(words)), np.uint32), np.zeros((width, len(words)), np.uint32)
    left[place, row] = points
    right[np.repeat(sizes, sizes) - 1 - place, row] = points
    return left, right


def _compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    words = table.column("word").to_pylist()
    key, tile, own, m, side, n, alone = (table.column(c).to_numpy() for c in ("key", "tile", "own", "m", "side", "n", "alone"))
    sizes = np.array([len(w) for w in words], np.int64)
    left, right = _matrices(words, sizes)
    a, b, c = (m + 2) // 3, m // 3, (m + 1) // 3
    edges = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(tile) != 0), True])

    def near(i: np.ndarray, j: np.ndarray, prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Which pairs are near and are told by this block, not by an earlier one that both are in."""
        longer, shorter = np.maximum(sizes[i], sizes[j]), np.minimum(sizes[i], sizes[j])
        ok = (prefix < longer) & (prefix + suffix >= longer - 1) & (longer - shorter <= 1) & (shorter == m[i]) & (m[i] == m[j]) & (side[i] == side[j]) & (alone[i] | (own[i] != own[j]))
        first = prefix >= a[i] + b[i]
        outer = ~first & (prefix >= a[i]) & (suffix >= c[i])
        last = ~first & ~outer & (suffix >= b[i] + c[i])
        return ok & np.choose(side[i], (first, outer, last))

    def told(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        both = np.concatenate([i, j]), np.concatenate([j, i])
        text = [pa.array([words[x] for x in side_], pa.string()) for side_ in both]
        return pa.RecordBatch.from_arrays([text[0], pa.array(n[both[0]], pa.int64()), text[1], pa.array(n[both[1]], pa.int64())], names=NEAR.names)

    small = np.diff(edges) < DENSE
    # few words: all pairs of all small groups as one list, worked through in parts
    rows = np.concatenate([np.arange(s, e) for s, e in zip(edges[:-1][small], edges[1:][small])] or [np.empty(0, np.int64)])
    partners = np.repeat(edges[1:][small], np.diff(edges)[small]) - rows - 1
    cuts = np.searchsorted(np.cumsum(partners), np.arange(PAIRS, partners.sum() + PAIRS, PAIRS))
    for s, e in zip(np.r_[0, cuts[:-1] + 1] if len(cuts) else [], np.minimum(cuts + 1, len(rows))):
        own_rows, count = rows[s:e], partners[s:e]
        i = np.repeat(own_rows, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        prefix, suffix = (_common(x, i, j) for x in (left, right))
        hit = near(i, j, prefix, suffix)
        if hit.any():
            yield told(i[hit], j[hit])
    for s, e in zip(edges[:-1][~small], edges[1:][~small]):
        width = int(sizes[s:e].max())
        step = max(1, PAIRS // (e - s))
        for at in range(s, e, step):
            stop = min(at + step, e)
            prefix, suffix = (_common_dense(x[:width, at:stop], x[:width, s:e]) for x in (left, right))
            p, q = np.nonzero(prefix + suffix >= np.maximum(sizes[at:stop, None], sizes[None, s:e]) - 1)
            i, j = p + at, q + s
            once = i < j
            i, j, p, q = i[once], j[once], p[once], q[once]
            hit = near(i, j, prefix[p, q].astype(np.int64), suffix[p, q].astype(np.int64))
            if hit.any():
                yield told(i[hit], j[hit])


def _common(points: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the columns ``i`` and ``j``."""
    out, alive = np.zeros(len(i), np.int64), np.arange(len(i))
    for row in points:
        own = row[i[alive]]
        alive = alive[(own == row[j[alive]]) & (own != 0)]
        if not len(alive):
            break
        out[alive] += 1
    return out


def _common_dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each column of ``a`` with each of ``b``."""
    alive, out = np.ones((a.shape[1], b.shape[1]), bool), np.zeros((a.shape[1], b.shape[1]), np.int32)
    for x, y in zip(a, b):
        alive &= (x[:, None] == y[None, :]) & (x != 0)[:, None]
        if not alive.any():
            break
        out += alive
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", letters: str = "A-Za-zÀ-ÿ", min_chars: int = 6, noise: int | None = None) -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of letters of at least ``min_chars`` code points, and how often they stand in all texts.

    ``noise`` plants misspellings, for tests and the query: a run whose crc32
    with its document's id is divisible by it loses one code point. A null id
    plants none; a null text has no words.
    """
    found = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([{letters}]{{{min_chars},}})"), F.lit(1))).alias("_w"))
    word = F.translate("_w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = found.select("_id", word.alias("_w"))
    if noise:
        rows = rows.select("_w", F.crc32(F.concat("_id", F.lit(":"), "_w").cast("binary")).alias("_h"))
        at = (F.col("_h") % F.length("_w")).cast("int")
        cut = F.concat(F.left("_w", at), F.substr("_w", at + 2))
        rows = rows.select(F.when(F.col("_h") % noise == 0, cut).otherwise(F.col("_w")).alias("_w"))
    return rows.where(F.length("_w") >= min_chars).groupBy(F.col("_w").alias("word")).agg(F.count("*").alias("n"))


def variants(words: DataFrame, ratio: int = 5, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    A word's form is the commonest of its near words (ties: the smallest in
    code-point order) if that is ``ratio`` times as common or more. The root is
    where following forms ends. A form is ``ratio`` times as common, so the way
    to the root has at most log(n) steps, and pointers are doubled as often as
    the largest count asks for.
    """
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near"))
    near = near_pairs(words, tile).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_b"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("_b.near").alias("_near"), (-F.col("_b.k")).alias("_near_n"))
    is_form = F.col("_near_n") >= ratio * F.col("n")
    formed = cut_lineage(known.select("word", "n", "n_near", F.when(is_form, F.col("_near")).alias("form"), F.when(is_form, F.col("_near_n")).alias("form_n")))
    most = formed.agg(F.max("n")).first()[0] or 1
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    reach, steps = 1, 0
    while ratio**steps <= most:
        steps += 1
    while reach < steps:
        following = links.select(F.col("word").alias("to"), F.col("to").alias("_next"))
        links = cut_lineage(links.join(following, "to", "left").select("word", F.coalesce("_next", "to").alias("to")))
        reach *= 2
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
