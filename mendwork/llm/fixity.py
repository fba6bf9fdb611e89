"""Merkle fixity audit of archived web records.

A record's leaf is the hash of its bytes. Leaves are ordered by offset within
their file; ranges of offsets (``range_bytes``, then ``fan`` ranges of the
level below, and so on to the file's root) hash what lies in them. Two
replicas are compared root by root, and only the children of ranges that
differ are compared further, down to the records that are corrupt, missing or
extra.

Scale: records are hashed where they are and only hashes move. A group is one
range: its size is bounded by ``range_bytes`` at the lowest level and by
``fan`` above; the root alone has a child for every range_bytes *
fan^(height - 1) bytes of its file (16 MiB by default). The levels below a differing range are
reached by semi joins, so an intact archive costs one comparison of roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def leaves(records: DataFrame, file: Column, offset: Column, payload: Column) -> DataFrame:
    """(file, offset, bytes, hash) of each record; a null payload hashes as empty.

    Rows without a file or an offset cannot be placed and are left out; of
    repeated records at one offset, the one with the smallest hash counts.
    """
    size, digest = digest_of(payload)
    return placed(records.select(file.cast("string").alias("file"), offset.cast("long").alias("offset"), size.alias("bytes"), digest.alias("hash")))


def digest_of(payload: Column) -> tuple[Column, Column]:
    """Bytes and SHA-256 of a record; null counts as empty."""
    data = F.coalesce(payload.cast("binary"), F.lit(b""))
    return F.octet_length(data).cast("long"), F.sha2(data, 256)


def placed(rows: DataFrame) -> DataFrame:
    """Leaves from (file, offset, bytes, hash) of records hashed elsewhere."""
    return rows.dropna(subset=["file", "offset"]).groupBy("file", "offset").agg(F.min(F.struct("hash", "bytes")).alias("r")).select("file", "offset", "r.bytes", "r.hash")


def levels(leaf: DataFrame, range_bytes: int, fan: int, height: int) -> list[DataFrame]:
    """Nodes (replica, file, range, hash, records, bytes) from the lowest ranges to the root.

    ``leaf`` holds the leaves of all replicas with a column ``replica``. Every
    level is written to the shared folder, as the next one is built on it.
    """
    node = leaf.select("replica", "file", F.col("offset").alias("at"), "hash", F.lit(1).cast("long").alias("records"), "bytes")
    out = []
    for level in range(height + 1):
        # the last level is the file's root
        key = F.lit(0).cast("long") if level == height else F.floor(F.col("at") / (range_bytes if level == 0 else fan)).cast("long")
        parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: F.concat_ws(":", x["at"].cast("string"), x["hash"]))
        made = node.withColumn("range", key).groupBy("replica", "file", "range").agg(F.sha2(F.array_join(parts, ",").cast("binary"), 256).alias("hash"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
        out.append(cut_lineage(made))
        node = out[-1].withColumnRenamed("range", "at")
    return out


def _hashes() -> list[Column]:
    return [F.max(F.when(F.col("replica") == r, F.col("hash"))).alias(f"hash_{r}") for r in "ab"]


def _differ(nodes: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Keys whose hashes differ between the replicas a and b, or that one of them lacks."""
    return nodes.groupBy(*keys).agg(*_hashes(), *more).where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(a: DataFrame, b: DataFrame, range_bytes: int = 65536, fan: int = 16, height: int = 3) -> tuple[DataFrame, DataFrame]:
    """(roots, damage) of two replicas given as leaves.

    roots: per file root_a, root_b (null where a replica lacks the file),
    records and bytes of ``a`` (null if it lacks the file), intact. damage: per
    record that differs its file, offset, bytes (of ``a`` where it has the
    record) and status corrupt, missing (not in ``b``) or extra. Two empty
    replicas give no rows. ``height`` levels of ranges stand below the root:
    the root has a child per range_bytes * fan^(height - 1) bytes.
    """
    leaf = cut_lineage(a.withColumn("replica", F.lit("a")).unionByName(b.withColumn("replica", F.lit("b"))))
    up = levels(leaf, range_bytes, fan, height)
    of_a = lambda c: F.max(F.when(F.col("replica") == "a", F.col(c))).alias(c)
    roots = up[-1].groupBy("file").agg(*_hashes(), of_a("records"), of_a("bytes"))
    roots = roots.select("file", F.col("hash_a").alias("root_a"), F.col("hash_b").alias("root_b"), "records", "bytes", F.col("hash_a").eqNullSafe(F.col("hash_b")).alias("intact"))
    suspect, keys = roots.where("NOT intact").select("file"), ["file"]
    for level in range(height - 1, -1, -1):
        own = up[level]
        if level < height - 1:  # below the root's children: only inside ranges that differ
            own, keys = own.withColumn("parent", F.floor(F.col("range") / fan).cast("long")), ["file", "parent"]
        suspect = _differ(own.join(suspect, keys, "left_semi"), ["file", "range"]).select("file", F.col("range").alias("parent"))
    inside = leaf.withColumn("parent", F.floor(F.col("offset") / range_bytes).cast("long")).join(suspect, ["file", "parent"], "left_semi")
    damage = _differ(inside, ["file", "offset"], of_a("bytes"), F.max("bytes").alias("_any"))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("corrupt")
    return roots, damage.select("file", "offset", F.coalesce("bytes", "_any").alias("bytes"), status.alias("status"))
