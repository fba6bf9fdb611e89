"""Best-fit packing of documents into sequences under several capacities.

A bin (sequence) has three residual capacities: tokens, documents and
attention cost (the sum of squared piece lengths, what block-diagonal
attention pays). Pieces are placed longest first into the open bin that fits
them under every constraint and scores best, by the weighted norm of what
would remain ("norm", least wins) or by the weighted dot product of what the
piece needs and what is left ("dot", most wins; Panigrahy et al. 2011).

Only documents longer than a sequence are cut: the first piece takes the
remainder, all others fill a sequence each and need no packing. First pieces
are dealt by a hash of their places in the written table into groups of about
``group_size``, each an even sample of all lengths however many pieces are
alike, and each group is packed by one task. A group
ends with a bin or two that are not full, so a larger group wastes less and a
smaller one takes less memory; both stay the same at any size of the input.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, cut_lineage
from .tokens import VOCABULARY, ByteBpe


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence; the defaults leave tokens as the binding one."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1)
    rule: str = "norm"


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def pieces(docs: DataFrame, text: str = "text", tokens: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Token pieces of every document: ids of the whole text, then ``end_id``.

    Null and empty texts are one piece with the end alone. ``ids`` holds the
    piece's ids as little-endian 32-bit numbers, or null without ``with_ids``.
    Repeated rows give repeated pieces; other columns are ignored.
    """

    def cut(batches):
        bpe = ByteBpe(vocabulary)
        for batch in batches:
            columns: list[list] = [[] for _ in PIECES]
            for doc, b in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                ids = np.append(bpe.ids(b), np.uint32(end_id)).astype("<u4")
                raw, n = ids.tobytes(), len(ids)
                first = (n - 1) % tokens + 1
                starts = [0, *range(first, n, tokens)]
                for number, start in enumerate(starts):
                    stop = first if number == 0 else start + tokens
                    part = raw[4 * start : 4 * stop]
                    row = (doc, number, start, stop - start, zlib.crc32(part), part if with_ids else None)
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=PIECES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths must come longest first.

    Equal pieces are placed together: all open bins are scored at once, and a
    heap then hands out the best bin, which goes back with its new score while
    the next equal piece still fits.
    """
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    weights = np.array(capacity.weights)
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    left = np.tile(limit, (max(1, n), 1))
    count = 0

    def score(rows: np.ndarray, need: np.ndarray) -> np.ndarray:
        if capacity.rule == "dot":
            return -((rows / limit) * (need / limit)) @ weights
        return (((rows - need) / limit) ** 2) @ weights

    at = 0
    while at < n:
        size = int(lengths[at])
        need = np.array([size, 1, size * size], dtype=float)
        if (need > limit).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        stop = at
        while stop < n and lengths[stop] == size:
            stop += 1
        fits = np.flatnonzero((left[:count] >= need).all(axis=1))
        heap = list(zip(score(left[fits], need).tolist(), fits.tolist()))
        heapq.heapify(heap)
        for i in range(at, stop):
            if heap:
                _, chosen = heapq.heappop(heap)
            else:
                chosen, count = count, count + 1
            bins[i], offsets[i] = chosen, int(limit[0] - left[chosen, 0])
            left[chosen] -= need
            if (left[chosen] >= need).all():
                heapq.heappush(heap, (float(score(left[chosen][None, :], need)[0]), chosen))
        at = stop
    return bins, offsets


def pack(parts: DataFrame, capacity: Capacity = Capacity(), group_size: int = 8192) -> DataFrame:
    """Append sequence_id and offset to pieces from ``pieces``.

    sequence_id is unique: packed pieces get a number from group and bin, full
    pieces a negative one each. The pieces are written first, so their places
    are settled; within a group, pieces of equal length are ordered by their
    values, so a task that runs again gives the same bins, where fully equal
    pieces may swap. No pieces give no rows.
    """
    parts = cut_lineage(parts)  # texts are encoded once for both branches
    alone = (F.col("length") == capacity.tokens) & F.lit(capacity.documents >= 1)
    full = parts.where(alone).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.where(~alone)
    groups = max(1, -(-rest.count() // group_size))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    schema = T.StructType([*parts.schema, T.StructField("group", T.IntegerType()), T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType())])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        pdf["bin"], pdf["offset"] = best_fit(pdf["length"].to_numpy(), capacity)
        return pdf

    packed = dealt.groupBy("group").applyInPandas(place, schema)
    packed = packed.withColumn("sequence_id", F.col("group").cast("long") * (1 << 32) + F.col("bin"))
    return packed.select(full.columns).unionByName(full)
