import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def products(spark):
    i = F.col("id")
    return spark.range(20).select(
        i.cast("int").alias("pos"), F.format_string("MK-%d", i + 1001).alias("product_id"), F.format_string('Item "x" & %d', i).alias("product_name"), (i * 1201.5 + 449).alias("price"), F.lit("INR").alias("currency"),
        ((40 + i % 8) / 10).alias("rating"), (i * 250 + 219).alias("review_count"), F.when(i == 6, "Out of Stock").otherwise("In Stock").alias("availability"),
        F.format_string("http://127.0.0.1:8765/p/MK-%d", i + 1001).alias("product_url"), F.format_string("http://127.0.0.1:8765/img/MK-%d.jpg", i + 1001).alias("image_url"), F.create_map().cast("map<string,string>").alias("loose"),
    ).cache()


@pytest.fixture(scope="session")
def site(products):
    from mendwork.sources.layouts import pages

    return pages(products).cache()
