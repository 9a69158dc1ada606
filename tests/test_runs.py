"""Joins that give many more pairs than they read rows: the same pairs as one by one, and given run by run."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from homelens.operators import correlate

T0 = dt.datetime(2024, 3, 1)
ASKED, NAMED = "id long, client string, queried_at timestamp_ntz", "value string, kind string, device_id long, first_seen timestamp_ntz"


@pytest.mark.parametrize("run, tasks, most", [(512, 240, 10**7), (7, 3, 40), (1, 2, 1)])
def test_values_of_many_devices_are_joined_as_before(spark, run, tasks, most):
    draw = random.Random(run)
    at = lambda: draw.choice([None, *(T0 + dt.timedelta(minutes=m) for m in range(40))])
    asked = [(draw.choice([None, i, i]), draw.choice(["hot", " hot ", "hot", "b", "none", "", None]), at()) for i in range(300)] + [(7, "hot", T0)] * 2
    named = [(draw.choice(["hot", "hot", "b", "", None]), draw.choice(["hostname", "dns_client", "other", None]), draw.choice([None, *range(9)]), at()) for _ in range(120)]
    q, n = spark.createDataFrame(asked, ASKED), spark.createDataFrame(named, NAMED)
    rows = lambda df: sorted(map(str, df.select("id", "device_id", "kind").collect()))
    want = rows(correlate.identifier_join(q, n))
    assert rows(correlate.crowded_join(q, n, run, tasks, most)) == want and len(want) > 1000


def test_pairs_of_a_crowd_come_in_runs_from_many_tasks(spark):
    """600 lookups of a name that 50 devices show: a device's rows stand together, and tasks do not follow the few bytes read."""
    q = spark.range(600).selectExpr("id", "'hot' AS client", "TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 1, id) AS queried_at")
    n = spark.range(50).selectExpr("'hot' AS value", "'hostname' AS kind", "id AS device_id", "TIMESTAMP_NTZ '2024-03-01 00:00:00' AS first_seen")
    out = correlate.crowded_join(q, n).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r["id"], r["device_id"]) for r in out}) == len(out) == 30_000
    assert sum(a["device_id"] != b["device_id"] for a, b in zip(out, out[1:])) < 2 * 50
    dealt = correlate.crowded_join(q, n, most=3000).withColumn("task", F.spark_partition_id()).collect()
    assert len({(r["id"], r["device_id"]) for r in dealt}) == len(dealt) == 30_000 and len({r["task"] for r in dealt}) > 4


CLAIM = "ip string, device_id long, observed_from timestamp_ntz, observed_to timestamp_ntz"


@pytest.mark.parametrize("width, run", [(86400, 512), (7200, 3), (1800, 1)])
def test_candidates_in_runs_are_those_of_pairs(spark, width, run):
    draw = random.Random(width)
    at = lambda: T0 + dt.timedelta(minutes=30 * draw.randrange(90))
    asked = spark.createDataFrame([(i, draw.choice(["hot", "a", None]), draw.choice(["n1", "n2", ""]), at()) for i in range(200)], "id long, ip string, client string, queried_at timestamp_ntz")
    held = [(draw.choice(["hot", "a"]), draw.choice([None, *range(6)]), b, draw.choice([None, b, b + dt.timedelta(hours=draw.randrange(9))])) for b in (at() for _ in range(60))]
    spans = correlate.merged_spans(spark.createDataFrame(held, CLAIM))
    named = correlate.identifier_join(asked, spark.createDataFrame([("n1", "hostname", 1, T0), ("n2", "dns_client", 9, at())], NAMED))
    pairs = correlate.interval_join(asked, spans).select("id", "device_id", F.lit("ip").alias("kind")).unionByName(named)
    devices = spark.createDataFrame([(k, f"d{k}") for k in range(5)], "device_id long, display_name string")
    rows = lambda df: sorted(map(str, df.select("id", "device_id", "display_name").collect()))
    want = rows(correlate.review_candidates(correlate.review_queue(correlate.attribution(asked, pairs)), devices))
    queue = correlate.review_queue(correlate.verdicts(asked, spans, named))
    assert rows(correlate.queued_candidates(queue, spans, devices, width, run, 3)) == want and len(want) > 300


def test_candidates_of_a_crowd_come_in_runs(spark):
    """200 lookups of an address that 40 devices hold: a device's rows stand together."""
    q = spark.range(200).selectExpr("id", "'hot' AS ip", "TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 1, id) AS queried_at")
    spans = correlate.merged_spans(spark.range(40).selectExpr("'hot' AS ip", "id AS device_id", "TIMESTAMP_NTZ '2024-02-01 00:00:00' AS observed_from", "CAST(NULL AS timestamp_ntz) AS observed_to"))
    devices = spark.range(40).selectExpr("id AS device_id", "concat('d', id) AS display_name")
    out = correlate.queued_candidates(correlate.review_queue(correlate.verdicts(q, spans, None)), spans, devices).collect()
    assert len({(r["id"], r["device_id"]) for r in out}) == len(out) == 8000 and {r["display_name"] for r in out} == {f"d{k}" for k in range(40)}
    assert sum(a["device_id"] != b["device_id"] for a, b in zip(out, out[1:])) < 2 * 40
