"""Materialised stages in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without it gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mendwork-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, so that a lost executor loses none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def large(df: DataFrame) -> DataFrame:
    """``df`` for a join in which it is never sent whole to every task through the driver.

    Spark guesses the size of what a page gives from the table that the page
    was made of, which can be a hundred times less than it is.
    """
    return df.hint("merge")
