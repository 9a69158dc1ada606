"""Verdicts from counted holders against those from paired evidence: spans that overlap, touch or are empty, and nulls."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from homelens.operators import correlate

T0 = dt.datetime(2024, 3, 1)
CLAIM = "ip string, device_id long, observed_from timestamp_ntz, observed_to timestamp_ntz"


def tables(spark, seed, lookups=240, spans=70):
    draw = random.Random(seed)
    at = lambda: T0 + dt.timedelta(seconds=draw.randrange(0, 60 * 3600, 1800))
    ips = ["hot", "hot", "a", "b", "own", None]
    asked = [(i, draw.choice(ips), draw.choice(["n1", " n2 ", "n3", "", "none"]), at()) for i in range(lookups)]
    held = []
    for _ in range(spans):
        begin, ip = at(), draw.choice(ips)
        end = draw.choice([None, begin, begin + dt.timedelta(minutes=30 * draw.randrange(-2, 12))])
        held.append((ip, 1 if ip == "own" else draw.choice([None, 1, 2, 3, 4]), begin, end))
    names = [("n1", "dns_client", 1, T0), ("n1", "hostname", 2, at()), ("n2", "hostname", 3, at()), ("n3", "dns_client", 4, at())]
    q = spark.createDataFrame(asked, "id long, ip string, client string, queried_at timestamp_ntz").repartition(3)
    return q, spark.createDataFrame(held, CLAIM), spark.createDataFrame(names, "value string, kind string, device_id long, first_seen timestamp_ntz")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_lists_and_candidates_are_those_of_pairs(spark, seed):
    q, a, n = tables(spark, seed)
    named, moved, spans = correlate.identifier_join(q, n), correlate.reassigned_addresses(q, a), correlate.merged_spans(a)
    pairs = correlate.interval_join(q, a).select("id", "device_id").withColumn("kind", F.lit("ip")).unionByName(named)
    paired = correlate.attribution(correlate.windowed(q), pairs, moved)
    want = {r["id"]: r for r in paired.collect()}
    counted = correlate.verdicts(correlate.windowed(q), spans, named, moved)
    short = ["id", "status", "device_id", "confidence", "needs_review"]
    got = counted.select(*short).collect()
    assert len(got) == len(want) and {r["id"]: tuple(r) for r in got} == {i: tuple(r[c] for c in short) for i, r in want.items()}
    lists = correlate.listed(counted, spans).select("id", "candidates", "evidence", "conflicts").collect()
    assert len(lists) == len(want)
    for r in lists:
        w = want[r["id"]]
        assert r["candidates"] == w["candidates"] and r["conflicts"] == w["conflicts"]
        key = lambda e: (e["kind"], e["device_id"] or 0)
        assert sorted(r["evidence"], key=key) == sorted(w["evidence"], key=key)
    devices = spark.createDataFrame([(k, f"d{k}") for k in (1, 2, 3)], "device_id long, display_name string")
    told = Counter(map(tuple, correlate.review_candidates(correlate.review_queue(paired), devices).select("id", "device_id", "display_name").collect()))
    assert Counter(map(tuple, correlate.queued_candidates(correlate.review_queue(counted), spans, devices).collect())) == told
    assert {r["status"] for r in got} == {"attributed", "ambiguous", "unattributed"}


def test_holders_of_one_address_are_counted_not_paired(spark):
    """2,000 lookups and 2,000 open spans of one address: no step gives more than a few rows for each of them."""
    q = spark.range(2000).selectExpr("id", "'hot' AS ip", "TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_interval(0, 0, 0, 1, 0, 0, id / 10) AS queried_at")
    a = spark.range(2000).selectExpr("'hot' AS ip", "id AS device_id", "TIMESTAMP_NTZ '2024-03-01 00:00:00' AS observed_from", "CAST(NULL AS timestamp_ntz) AS observed_to")
    out = correlate.verdicts(q, correlate.merged_spans(a), None)
    assert {tuple(r) for r in out.select("status", "holders").distinct().collect()} == {("ambiguous", 2000)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("seed, seconds", [(4, 3600), (5, 1800), (6, 900), (7, 86400), (8, 5000)])
def test_text_and_holders_are_those_of_pairs_in_slots_of_any_length(spark, seed, seconds):
    q, a, n = tables(spark, seed)
    named, spans = correlate.identifier_join(q, n), correlate.merged_spans(a)
    pairs = {(r["id"], "ip", r["device_id"]) for r in correlate.interval_join(q, a).collect()}
    pairs |= {(r["id"], r["kind"], r["device_id"]) for r in named.collect()}
    want = {r["id"]: [] for r in q.select("id").collect()}
    for i, kind, device in sorted(p for p in pairs if p[2] is not None):
        want[i].append(f"{kind}:{device}")
    counted = correlate.verdicts(correlate.windowed(q), spans, named)
    got = correlate.with_text(counted, spans, seconds).select("id", "evidence").collect()
    assert len(got) == len(want) and {r["id"]: r["evidence"] for r in got} == {i: ",".join(texts) for i, texts in want.items()}
    names = spans.withColumn("name", F.concat(F.lit("d"), "device_id"))
    for r in correlate.with_holders(counted.filter("holders > 1"), names, seconds, ("name",)).select("id", "held").collect():
        held = sorted(p[2] for p in pairs if p[:2] == (r["id"], "ip") and p[2] is not None)
        assert [(e["device_id"], e["name"]) for e in r["held"] if e["device_id"] is not None] == [(d, f"d{d}") for d in held]


def test_spans_that_hold_a_whole_slot_are_not_asked_for_each_lookup(spark):
    """2,000 spans of one address, of which 3 start or end within an hour: its lookups meet at most 4 runs in place of 2,000 spans."""
    at = lambda m: f"TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {m}, 0)"
    begin, end = at("IF(id = 7, 90, 0)"), at("CASE id WHEN 1000 THEN 100 WHEN 1999 THEN 110 ELSE 240 END")
    a = spark.range(2000).selectExpr("'hot' AS ip", "id AS device_id", f"{begin} AS observed_from", f"{end} AS observed_to")
    q = spark.range(240).selectExpr("id", "'hot' AS ip", f"{at('CAST(id AS int)')} AS queried_at")
    runs = correlate.held_runs(q, a, F.col("device_id")).select("_slot", F.size("_runs").alias("n"), F.aggregate("_runs", F.lit(0), lambda t, x: t + F.size(x["rest"])).alias("whole")).orderBy("_slot").collect()
    assert [(r["n"], r["whole"]) for r in runs] == [(1, 1999), (4, 1997), (1, 1998), (1, 1998)]
    texts = {r["id"]: r["evidence"].split(",") for r in correlate.with_text(correlate.verdicts(q, correlate.merged_spans(a), None), correlate.merged_spans(a)).collect()}
    assert {i: len(t) for i, t in texts.items()} == {m: 1999 + (m >= 90) - (m >= 100) - (m >= 110) for m in range(240)}
