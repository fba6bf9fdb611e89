"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly if some value lies within
r/2 bits of both. So every distinct fingerprint emits all variants within half
the radius, variants are shuffled together, and fingerprints that meet on one
are verified and linked.

A 64-bit fingerprint has 2,081 variants for r = 4. They are never written as
rows: a variant's partition is its leading ``prefix_bits``, and a fingerprint
has variants in few partitions (its own prefix with up to r/2 bits flipped), so
it is sent once to each of these, and the receiving task makes the variants
that belong there. Every variant still meets every other in exactly one task.
A partition with too many fingerprints (near copies have near prefixes) is
split into slices by a linear hash of the variant: the hash of a fingerprint
with some bits flipped is the hash of the fingerprint and that of the flips
together, so that a slice makes its own variants only, and each is made once.
No link is lost either way.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, cut_lineage, with_columns
from .components import connected_components

BITS = 64
TASK_VARIANTS = 4_000_000  # variants held by one task at a time: about 100 MB
MAX_PREFIX_BITS = 16  # 65,536 partition counts: the bound of what reaches the driver

_ONE = np.uint64(1)
_BYTE_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def shingle_hashes(b: bytes | None, width: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of ASCII-lower-cased text."""
    words = (b or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """Append ``fingerprint`` (long with the 64 bits; null and wordless texts: 0)."""

    def make():
        def prints(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            got = [fingerprint(shingle_hashes(b, width)) for b in byte_texts(batch.column(text))]
            return {"fingerprint": pa.array(np.array(got, dtype=np.uint64).view(np.int64))}

        return prints

    return with_columns(df, make, T.StructType([T.StructField("fingerprint", T.LongType())]))


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` ones."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _parities(bits: int) -> np.ndarray:
    """Words whose overlap with a value, even or odd, gives the bits of a linear hash."""
    return np.random.default_rng(3).integers(0, 1 << 63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def linear_hash(x: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits with linear_hash(x ^ y) = linear_hash(x) ^ linear_hash(y)."""
    out = np.zeros(len(x), dtype=np.int64)
    for i, word in enumerate(_parities(bits)):
        out |= (np.bitwise_count(x & word) & 1).astype(np.int64) << i
    return out


def meet(prints: np.ndarray, bucket: int, prefix_bits: int, radius: int, piece: int = 0, piece_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a variant with prefix ``bucket`` and hash ``piece``.

    Returns the ends of a spanning forest of the verified links: as many links
    as there are fingerprints at most, which keeps every connection.
    """
    half = radius // 2
    prints = np.unique(prints)
    n = len(prints)
    if n < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = BITS - prefix_bits
    flips = np.bitwise_count((prints >> np.uint64(low)) ^ np.uint64(bucket)) if prefix_bits else np.zeros(n, dtype=np.uint8)
    index_bits = max(1, (n - 1).bit_length())
    mask = np.uint64((1 << index_bits) - 1)
    rest = prints & np.uint64((1 << low) - 1) if low < BITS else prints
    share = linear_hash(rest, piece_bits)
    keys = []
    for d in range(half + 1):
        every = ball(low, half - d)
        of_masks = linear_hash(every, piece_bits)
        near = np.flatnonzero(flips == d)
        for h in np.unique(share[near]).tolist() if piece_bits else [0]:
            # the flips that lead from fingerprints of hash h into this piece
            masks, own = (every[of_masks == piece ^ h], near[share[near] == h]) if piece_bits else (every, near)
            if not len(masks):
                continue
            step = max(1, TASK_VARIANTS // (4 * len(masks)))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                key = _mixed((rest[some][:, None] ^ masks[None, :]).ravel())
                index = np.repeat(some.astype(np.uint64), len(masks))
                # the hash of the variant above, the fingerprint's place below: one sort brings equal variants together
                keys.append((key & ~mask) | index)
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key = np.concatenate(keys)
    key.sort()
    same = np.flatnonzero(((key[1:] ^ key[:-1]) & ~mask) == 0)
    a, b = (key[same] & mask).astype(np.int64), (key[same + 1] & mask).astype(np.int64)
    near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
    pairs = np.unique((a[near] << 32) | b[near])
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    if not near.all():  # different variants with one hash: compare all fingerprints of such runs
        more = [_compare(prints, np.unique((key[lo:hi] & mask).astype(np.int64)), radius) for lo, hi in _runs(key, same[~near], mask)]
        a, b = np.concatenate([a, *(x for x, _ in more)]), np.concatenate([b, *(y for _, y in more)])
    roots = _roots(n, a, b)
    tied = np.flatnonzero(roots != np.arange(n))
    signed = prints.view(np.int64)
    return signed[tied], signed[roots[tied]]


def _runs(key: np.ndarray, at: np.ndarray, mask: np.uint64) -> list[tuple[int, int]]:
    top = key & ~mask
    return sorted({(int(np.searchsorted(top, top[i], "left")), int(np.searchsorted(top, top[i], "right"))) for i in at})


def _compare(prints: np.ndarray, members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in range(len(members)):
        others = members[at + 1 :]
        near = others[np.bitwise_count(prints[others] ^ prints[members[at]]) <= radius]
        a.append(np.full(len(near), members[at]))
        b.append(near)
    return np.concatenate(a), np.concatenate(b)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component, by hooking and pointer jumping."""
    parent = np.arange(n)
    while True:
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            return parent
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def near_links(prints: DataFrame, radius: int = 4, prefix_bits: int | None = None, task_variants: int = TASK_VARIANTS) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``radius`` bits.

    ``prints`` has one distinct long column ``fingerprint``. ``prefix_bits``
    follows the number of fingerprints unless given. Of the fingerprints only
    counts by prefix reach the driver.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: variants meet half-way")
    half, each = radius // 2, len(ball(BITS, radius // 2))
    if prefix_bits is None:
        wanted = prints.count() * each / task_variants
        prefix_bits = min(MAX_PREFIX_BITS, max(6, math.ceil(math.log2(max(1.0, 4 * wanted)))))
    shift = BITS - prefix_bits
    size = np.zeros(1 << prefix_bits, dtype=np.int64)
    for row in prints.groupBy(F.shiftrightunsigned("fingerprint", shift).alias("p")).agg(F.count("*").alias("n")).collect():
        size[row.p] = row.n
    masks = ball(prefix_bits, half).astype(np.int64)
    spread = [len(ball(shift, half - int(m).bit_count())) for m in masks]
    buckets = np.arange(1 << prefix_bits)
    load = sum(size[buckets ^ m] * s for m, s in zip(masks, spread))
    pieces = np.maximum(1, -(-load // task_variants)).astype(np.int64)
    hot = {int(k): min(16, int(pieces[k] - 1).bit_length()) for k in np.flatnonzero(pieces > 1)}  # bits of the slices' hash
    masks_of = [ball(shift, left) for left in range(half + 1)]

    def send(batches):
        for batch in batches:
            own = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(own):
                continue
            at = ((own >> np.uint64(shift)).astype(np.int64)[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(at, kind="stable")
            at = at[order]
            values = np.repeat(own, len(masks))[order]
            keys, starts = np.unique(at, return_index=True)
            ends = np.append(starts[1:], len(at))
            rows = []
            for k, s, e in zip(keys.tolist(), starts, ends):
                if k not in hot:
                    rows.append((k, 0, values[s:e].tobytes()))
                    continue
                # a slice gets the fingerprints that have variants in it
                share = linear_hash(values[s:e] & np.uint64((1 << shift) - 1), hot[k])
                flips = np.bitwise_count((values[s:e] >> np.uint64(shift)) ^ np.uint64(k))
                to: dict[int, list[np.ndarray]] = {}
                for d in range(half + 1):
                    for at in np.unique(linear_hash(masks_of[half - d], hot[k])).tolist():
                        own = np.flatnonzero(flips == d)
                        for h in np.unique(share[own]).tolist():
                            to.setdefault(at ^ h, []).append(values[s:e][own[share[own] == h]])
                rows += [(k, p, np.concatenate(x).tobytes()) for p, x in to.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "piece", "prints"])

    def receive(key: tuple[int, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, piece = int(key[0]), int(key[1])
        own = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in pdf["prints"]])
        a, b = meet(own, bucket, prefix_bits, radius, piece, hot.get(bucket, 0))
        return pd.DataFrame({"a": a, "b": b})

    sent = prints.select("fingerprint").mapInArrow(send, "bucket int, piece int, prints binary")
    return sent.groupBy("bucket", "piece").applyInPandas(receive, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(id, fingerprint, component_id, is_kept) for every row of ``docs``.

    component_id: the smallest id that is reachable over links of at most
    ``radius`` bits; null only where a whole component has null ids. is_kept:
    the rows of each component with its smallest id (repeated rows of that id
    are all marked). Null and wordless
    texts have fingerprint 0 and link like any other. Other columns of
    ``docs`` are ignored, so names cannot clash; no rows give no rows.
    """
    prints = cut_lineage(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).drop("text"))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    roots = connected_components(near_links(distinct, radius))
    grouped = distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    component = cut_lineage(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")))  # so that Spark can split a giant component in the join
    by_print = grouped.join(component, "root").select("fingerprint", "component_id")
    out = prints.join(by_print, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")
    return out.withColumn("is_kept", F.col(id_col).eqNullSafe(F.col("component_id")))
