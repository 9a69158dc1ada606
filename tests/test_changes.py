"""Versions to append, honest sentences, window texts, and largest spans as a stream."""

import random
from datetime import datetime, timedelta

import pytest
from homelens.functions import phrasing
from homelens.operators import changes, feedback, findings
from homelens.streaming import live
from pyspark.sql import functions as F


def test_patches_and_deletions_are_versions(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1, False), (1, "b", "x", 2, False), (2, "c", "y", 1, True)], "id long, name string, notes string, version long, deleted boolean")
    said = spark.createDataFrame([(1, None, "new"), (9, "z", "z")], "id long, name string, notes string")
    made = changes.patched(rows, said, "id", F.lit(3))
    assert [tuple(r) for r in made.collect()] == [(1, "b", "new", 3, False)]
    gone = changes.tombstones(rows.unionByName(made), rows.select("id"), "id", F.lit(4))
    assert [tuple(r) for r in gone.collect()] == [(1, "b", "new", 4, True)]
    assert feedback.latest_version(rows.unionByName(made).unionByName(gone), ["id"], deleted="deleted").isEmpty()


def test_claims_fail_the_job(spark):
    rows = spark.createDataFrame([("DNS lookup for a.example",), ("they watched a.example",)], "text string")
    with pytest.raises(Exception, match="content was seen"):
        phrasing.honest(rows, "text").collect()
    assert phrasing.honest(rows.limit(1), "text").count() == 1


def test_window_texts():
    assert (phrasing.window_seconds(" 24H "), phrasing.window_seconds("7d")) == (86400, 7 * 86400)
    for wrong in ("0h", "1w", "h", "-1d", "1.5h"):
        with pytest.raises(ValueError):
            phrasing.window_seconds(wrong)


def test_streamed_spans_end_like_the_batch(spark, tmp_path):
    draw = random.Random(4)
    t0 = datetime(2024, 1, 1)
    rows = sorted((t0 + timedelta(seconds=draw.randrange(4000)), k % 3, k) for k in range(120))
    for part in range(3):
        some = spark.createDataFrame(rows[part * 40 : part * 40 + 40], "seen_at timestamp, device_id long, id long").coalesce(1)
        some.write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.largest_spans(live.stream_table(spark, str(tmp_path / "in"), "seen_at timestamp, device_id long, id long", 1), "device_id", "seen_at", 300)
    query = stream.writeStream.format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["device_id"]: r["n"] for r in spark.table("spans").groupBy("device_id").agg(F.max("n").alias("n")).collect()}
    batch = findings.burst_spans(spark.createDataFrame(rows, "seen_at timestamp, device_id long, id long"), "device_id", "seen_at", "id", 300, 1)
    assert got == {r["device_id"]: r["n"] for r in batch.collect()}
