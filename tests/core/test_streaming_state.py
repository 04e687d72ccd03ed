import math
import tempfile

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")
from aerotally.streaming import flights  # noqa: E402


def test_state_goes_with_the_watermark_and_replays_alike(spark):
    folder, mark, out = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    schema = "flight long, shot long, x double, y double, t double"

    def arrive(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
        src = src.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
        q = flights.flight_metrics_in_time(src, lateness="10 seconds", idle_ms=60_000).writeStream.option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
        state = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        return state[-1] if state else None

    arrive([(1, 1, 0.0, 0.0, 100.0), (1, 2, 3.0, 4.0, 101.0), (2, 1, 5.0, 5.0, 100.0)], "a")
    run()
    arrive([(1, 3, 3.0, 5.0, 103.0), (1, 2, 9.0, 9.0, 101.0), (3, 1, 0.0, 0.0, 1000.0)], "b")
    run()
    arrive([(3, 2, 0.0, 1.0, 1001.0)], "c")
    run()
    arrive([(3, 3, 0.0, 3.0, 1002.0), (2, 9, 0.0, 0.0, 1003.0)], "d")
    left = run()
    got = {(r.flight, r.shot, r.late): r.distance_to_prev for r in spark.read.schema(flights.METRICS).parquet(out).collect()}
    steps = {k: v for k, v in got.items() if v is not None and not math.isnan(v)}
    assert steps == {(1, 2, False): 5.0, (1, 3, False): 1.0, (3, 2, False): 1.0, (3, 3, False): 2.0}
    assert (1, 2, True) in got and (2, 9, False) in got and len(got) == 9
    assert left is not None and left <= 6  # flights 2 and 3, each with its timer; flight 1 is gone
    before = len(got)
    run()  # nothing new: nothing is given twice
    assert spark.read.parquet(out).count() == before
