import random

from pyspark.sql import functions as F

from mendwork.operators.detect import detect_as_of
from mendwork.streaming import baseline


def test_restarted_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, n, rng.choice(["healthy", "warning", "repair_required"]), round(rng.random(), 2), rng.randint(0, 9), {"price": round(rng.random(), 2)}, rng.choice([[], ["type_drift:1"]]), rng.choice(["a", "b"])) for n in range(12) for s in range(5)]
    frame = spark.createDataFrame(rows, f"scraper_id bigint, {baseline.REPORT}")
    paths = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    for part in range(3):  # the query stops between the parts
        frame.where((F.col("run") >= part * 4) & (F.col("run") < part * 4 + 4)).orderBy(F.rand(2)).write.mode("append").parquet(paths[0])
        baseline.start(spark, *paths).awaitTermination()
    key = lambda r: (r.scraper_id, r.run)
    got = sorted(spark.read.parquet(paths[1]).collect(), key=key)
    want = sorted(detect_as_of(frame, ["scraper_id"]).collect(), key=key)
    assert len(got) == 60 and [r.asDict(True) for r in got] == [r.asDict(True) for r in want]
    # nothing new: nothing is written twice
    baseline.start(spark, *paths).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 60
