"""Keyed state of sources against the batch fold, over restarts, and silence by a timer."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from homelens.operators import health
from homelens.streaming import keyed

T0 = dt.datetime(2024, 5, 1)
ATTEMPT = "source string, tried_at timestamp_ntz, ok boolean"


def run(spark, folder, stream, schema):
    plan = stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    out = plan.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("late", [False, True])
def test_streamed_health_is_the_batch_fold(spark, tmp_path, late):
    draw = random.Random(4)
    rows = [(f"s{draw.randrange(4)}", T0 + dt.timedelta(seconds=30 * k), draw.random() < 0.45) for k in range(120)] + [("never", T0, False), ("once", T0, True)]
    rows.sort(key=lambda r: r[1])
    if late:
        draw.shuffle(rows)
    folder = str(tmp_path)
    for k in range(0, len(rows), 31):
        spark.createDataFrame(rows[k : k + 31], ATTEMPT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.1)
        if k == 31:
            run(spark, folder, lambda s: keyed.source_health(s, 600, 3), ATTEMPT)  # and a restart
    out = run(spark, folder, lambda s: keyed.source_health(s, 600, 3), ATTEMPT)
    last = out.filter("went_down_at IS NULL").groupBy("source").agg(F.max_by(F.struct("last_success_at", "last_attempt_at", "consecutive_failures"), "attempts").alias("r")).select("source", "r.*")
    fold = health.source_health(spark.createDataFrame(rows, ATTEMPT), "2024-05-01 02:00:00").select("source", F.col("last_success_at").cast("timestamp"), F.col("last_attempt_at").cast("timestamp"), "consecutive_failures")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, fold.collect()))
    if not late:
        want = []
        for s in {r[0] for r in rows}:
            status, good, streak = "down", None, 0
            for _, at, ok in (r for r in rows if r[0] == s):
                before = status
                good, streak = (at, 0) if ok else (good, streak + 1)
                status = "down" if good is None or streak >= 3 else "degraded" if streak or (at - good).total_seconds() >= 600 else "ok"
                want += [(s, at)] * (status == "down" and before != "down")
        got = out.filter("went_down_at IS NOT NULL").select("source", F.col("went_down_at").cast("timestamp_ntz")).collect()
        assert sorted(map(tuple, got)) == sorted(want) and want


def test_a_source_that_stops_is_silent_once_and_heard_again(spark, tmp_path):
    folder = str(tmp_path)
    line = "source string, seen_at timestamp_ntz"

    def say(*sources):
        spark.createDataFrame([(s, T0) for s in sources], line).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def until(found, seconds=90):
        stop = time.time() + seconds
        while time.time() < stop:
            got = [(r["source"], r["state"]) for r in spark.table("silence_rows").collect()]
            if sorted(got) == sorted(found):
                return True
            time.sleep(0.5)
        return got

    say("gateway", "resolver")
    stream = spark.readStream.schema(line).parquet(f"{folder}/in")
    query = keyed.silence(stream, 6).writeStream.format("memory").queryName("silence_rows").option("checkpointLocation", f"{folder}/marks").trigger(processingTime="1 second").start()
    try:
        first = [("gateway", "heard"), ("resolver", "heard"), ("gateway", "silent"), ("resolver", "silent")]
        assert until(first) is True  # no line came in between
        time.sleep(8)
        assert until(first, 1) is True  # once
        say("gateway")
        assert until([*first, ("gateway", "heard"), ("gateway", "silent")]) is True
    finally:
        query.stop()
