"""Streamed ticks and runs after restarts, against the batch queries over all attempts."""

import random

from pyspark.sql import functions as F

from millrace.operators import telemetry
from millrace.streaming import ticks

KIND = "event_id long, at long, ok boolean, pressure boolean, tokens long, lane long"


def test_ticks_and_runs_equal_the_batch_after_restarts(spark, tmp_path):
    dice, src = random.Random(3), str(tmp_path / "src")
    events = [(i, i * 700_000, not (bad := dice.random() < 0.6), bad, dice.randint(0, 50), dice.randint(0, 3)) for i in range(300)]
    for lo, hi in ((0, 90), (90, 91), (91, 220), (220, 300)):
        part = events[lo:hi]
        dice.shuffle(part)
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(KIND).parquet(src)
        ticks.keep_ticks(stream, 2, str(tmp_path / "ticks"), str(tmp_path / "c1")).awaitTermination()
        ticks.keep_runs(stream.withColumn("failed", F.col("pressure")), "event_id", str(tmp_path / "runs"), str(tmp_path / "c2")).awaitTermination()
    whole = spark.createDataFrame(events, KIND)
    batch = telemetry.ticks(whole, 2)
    streamed = ticks.kept_ticks(spark, str(tmp_path / "ticks"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(streamed) == rows(batch) and streamed.count() == 105
    deltas = lambda df: rows(telemetry.tick_deltas(df, 2).select("t", F.coalesce("gap_s", F.lit(-1)), F.coalesce("tok_s", F.lit(-1.0))))
    assert deltas(streamed) == deltas(batch)
    for least in (1, 3):
        want = telemetry.breaker_runs(whole, "event_id", F.col("pressure"), least).select("lane", "start", "stop", "n")
        assert rows(ticks.kept_runs(spark, str(tmp_path / "runs"), least)) == rows(want)


def test_nothing_streamed_yet(spark, tmp_path):
    assert ticks.kept_ticks(spark, str(tmp_path / "none")).count() == 0
    assert ticks.kept_runs(spark, str(tmp_path / "none"), 1).count() == 0
