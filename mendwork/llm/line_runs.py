"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key, docs, lo, hi), bucketed and sorted by key: how many
documents of one or more batches hold a line, and the smallest and largest of
them. A new batch is merge-joined with all runs, which need no shuffle for it,
adds a run of its own at level 0, and ``fan`` runs of a level are compacted
into one of the next: a key is in as many runs as there are levels times
``fan`` at most, and is rewritten once a level.

A key that ``min_docs`` (2 or 3) documents hold stays in the largest of them alone. The
documents in which a line is still standing follow from (docs, lo, hi): all of
them, two at most, as long as there are fewer than ``min_docs``, and ``hi`` from then
on. So a batch knows which lines it takes out, its own and those of earlier
batches, and writes them to a log of drops, (key, doc); every drop is written
once, whatever the number of batches. A batch's lines, anti-joined with the
log, are those that stay.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, shared_folder, with_columns

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)  # stands for a null id: one document, smaller than any other

RUN = "key binary, docs bigint, lo bigint, hi bigint"
KEPT = T.StructType([T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def line_key(line: Column) -> Column:
    """A line as it is compared: ASCII white space stripped, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def doc_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc, key): each key of at least ``min_chars`` code points once per row; a key is 128 bits."""
    keys = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_key), lambda k: F.length(k) >= min_chars)
    hashed = F.array_distinct(F.transform(keys, F.md5))
    return docs.select(doc_of(id_col).alias("doc"), F.explode(hashed).alias("_k")).select("doc", F.unhex("_k").alias("key"))


class LineRuns:
    """The runs of one corpus; batches are added in any order, a document's rows all in one batch."""

    def __init__(self, spark: SparkSession, fan: int = 3, min_docs: int = 3, buckets: int | None = None) -> None:
        if fan < 2 or min_docs not in (2, 3):
            raise ValueError("fan must be 2 or more; min_docs is 2 or 3, as a run knows two documents of a line")
        self.spark, self.fan, self.min_docs = spark, fan, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.at = f"{shared_folder(spark)}/{self.name}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.made}"
        self.made += 1
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.at}/{name}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(self.spark, f"{self.at}/{name}")

    def runs(self) -> list[DataFrame]:
        """The present runs, the largest level first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fan:
                # read as plain files: Spark 4.1 takes a union of bucketed tables as dealt by key, though its partitions are not merged
                rows = self.spark.read.schema(RUN).parquet(*[f"{self.at}/{name}" for name in names])
                self._write(rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), level + 1)
                for name in names:
                    self._forget(name)
                self.levels[level] = []
                return self._compact()

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (doc, key): its run is added, and what it drops is logged."""
        once = lines.select("key", "doc").dropDuplicates()
        own = once.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        self._write(own, 0)
        mine = self.levels[0][-1]
        state = self.spark.table(mine)
        docs, hi, standing = F.col("docs"), F.col("hi"), F.array().cast("array<bigint>")
        for n, run in enumerate(self.runs()[:-1]):  # the last one is the batch's own
            d, lo, h = (F.col(f"_{n}_{c}") for c in ("docs", "lo", "hi"))
            state = state.join(run.select("key", *[F.col(c).alias(f"_{n}_{c}") for c in ("docs", "lo", "hi")]), "key", "left")
            docs, hi = docs + F.coalesce(d, F.lit(0)), F.greatest(hi, h)
            standing = F.concat(standing, F.when(d.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(lo, h)))
        before = docs - F.col("docs")
        # before the limit is met both ends of every run stand, afterwards the largest document alone
        ends = F.array_distinct(standing)
        earlier = F.when(before >= self.min_docs, F.array(F.array_max(ends))).otherwise(ends)
        over = state.select("key", hi.alias("hi"), earlier.alias("earlier"), docs.alias("n")).where(F.col("n") >= self.min_docs)
        mine_dropped = once.join(over.select("key", "hi"), "key").where("doc <> hi").select("key", "doc")
        back = over.select("key", "hi", F.explode("earlier").alias("doc")).where("doc <> hi").select("key", "doc")
        mine_dropped.unionByName(back).write.mode("append").parquet(f"{self.at}/drops")
        self._compact()

    def drops(self) -> DataFrame:
        """(key, doc): the lines that are taken out by the batches so far."""
        if not self.made:
            return self.spark.createDataFrame([], "key binary, doc bigint")
        return self.spark.read.schema("key binary, doc bigint").parquet(f"{self.at}/drops")

    def standing(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (doc, key) that stay."""
        return lines.join(self.drops(), ["key", "doc"], "left_anti")

    def close(self) -> None:
        """Delete all runs and the log."""
        for level in self.levels:
            for name in level:
                self._forget(name)
        self.levels, self.made = [], 0
        _delete(self.spark, self.at)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20, batches: int = 4, fan: int = 3) -> DataFrame:
    """Append kept_text, n_lines and n_dropped: the text without the lines that three or more documents hold.

    A line stays in the document with the largest id that holds it, as often as
    it stands there; shorter lines stay everywhere. Documents come to the runs
    in ``batches`` by a hash of their id, which changes no result. Rows with
    one id are one document. A null id counts as one document smaller than all
    others. A null or empty text is one empty line, and its kept_text is empty.
    Ids are integers. Columns of these names are replaced, others pass.

    The texts are read twice, and go through one shuffle by id to meet their
    dropped keys; of a line, 24 bytes move. A task holds the keys dropped from
    one document at most.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, fan)
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    at = f"{runs.at}/lines"
    line_keys(docs, id_col, text, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(at)
    for n in range(batches):
        runs.add(spark.read.schema("doc bigint, key binary, batch int").parquet(at).where(F.col("batch") == n).drop("batch"))
    dropped = cut_lineage(runs.drops().groupBy("doc").agg(F.collect_set("key").alias("_dropped")).withColumnRenamed("doc", "_doc"))
    runs.close()
    joined = docs.join(dropped, doc_of(id_col) == F.col("_doc"), "left").drop("_doc")
    return with_columns(joined, lambda: _cutter(text, min_chars), KEPT).drop("_dropped")


def _cutter(name: str, min_chars: int):
    lower = str.maketrans(_UPPER, _LOWER)

    def cut(value: str | None, gone: list[bytes] | None) -> tuple[str, int, int]:
        lines = (value or "").split("\n")
        if not gone:
            return value or "", len(lines), 0
        dropped = set(gone)
        kept = [x for x in lines if len(k := x.strip(_SPACE).translate(lower)) < min_chars or hashlib.md5(k.encode()).digest() not in dropped]
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        text, gone = batch.column(name), batch.column("_dropped")
        rows = [cut(t.as_py(), g.as_py()) for t, g in zip(text, gone)]
        return {f.name: pa.array([r[n] for r in rows], pa.string() if n == 0 else pa.int64()) for n, f in enumerate(KEPT)}

    return run
