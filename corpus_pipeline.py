"""A corpus pipeline: each stage works on all documents its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mendwork.llm import decontaminate, gam, packing, quality_rules, simhash_sets
from mendwork.llm.common import remainder, shared_folder, table


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of good quality is 0.5 or more and that pass the base rule."""
    model = quality_rules.fit(quality_rules.with_stats(docs.select("text")))
    return quality_rules.keep(docs, model)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the labels held out of operator 9 are held out here too."""
    model = gam.fit_labels(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    return gam.above(docs, model, 0.3)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash_sets.keep_one(docs, width=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    packed = packing.pack(packing.pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", by_quality_rules),
    ("quality_classifier", by_classifier),
    ("simhash_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; what lies between is Parquet in the shared folder.

    That folder is deleted at the end: the last stage has written its pieces
    to the checkpoint folder by then and reads it no more.
    """
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return packed


#: Fitted models, connected components and token ids are beyond SQL. Tests hold the dedup stage against all pairs,
#: decontamination and packing against plain versions, and check run() as a whole for what it keeps.
ORACLE_SQL = None
