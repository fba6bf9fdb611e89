"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    A local session without that setting (tests, notebooks) gets a folder of
    its own; on a cluster, where executors could not meet there, it is an
    error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mendwork-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; a lost executor loses none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, a finished execution deletes its shuffle files at once; else they stay until the driver collects garbage.

    What is computed from a frame later on recomputes what it needs, so frames
    used twice belong in ``cut_lineage``. The session's setting is put back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames made by ``cut_lineage`` that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def remainder(id_col: str, divisor: int):
    """crc32 of the id's decimal text modulo ``divisor``; null ids give null, so they are in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def held_out(id_col: str, divisor: int, fold: int):
    """Whether an id is in the held-out fold; false for null ids, which are not learned from either."""
    return F.coalesce(remainder(id_col, divisor) == fold, F.lit(False)).alias("held_out")


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, null kept."""
    return column.cast(pa.large_binary()).to_pylist()


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """mapInArrow with one function per batch."""

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], added: T.StructType) -> DataFrame:
    """Append computed columns; an input column of the same name (any case) is replaced.

    ``make`` runs once in each task and returns the function from a batch to
    the new columns, so that lookup tables are built once.
    """
    new = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in new]
    schema = T.StructType([*kept, *added])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches):
        fn = make()
        for batch in batches:
            got = fn(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names] + [got[f.name] for f in added]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], names=arrow.names)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.Array]]) -> DataFrame:
    """Rows for which the function made by ``make`` gives true; all columns pass unchanged."""

    def run(batches):
        fn = make()
        for batch in batches:
            yield batch.filter(fn(batch))

    return df.mapInArrow(run, df.schema)
