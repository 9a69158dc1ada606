"""Interval joins by windows against brute force: open and empty spans, borders, nulls, hot addresses."""

import datetime as dt
import random
from collections import Counter

import pytest

from homelens.operators import correlate, skew

T0 = dt.datetime(2024, 3, 1)


def cases(seed, hot):
    draw = random.Random(seed)
    at = lambda: T0 + dt.timedelta(seconds=draw.randrange(0, 5 * 3600, 900))
    queries = [(i, "hot" if i % 3 == 0 else draw.choice(["a", "b", None, "c"]), at()) for i in range(hot)]
    spans = []
    for i in range(60):
        begin = at() - dt.timedelta(hours=draw.randrange(0, 3))
        end = draw.choice([None, begin, begin + dt.timedelta(seconds=draw.randrange(0, 4 * 3600, 900))])
        spans.append((draw.choice(["hot", "a", "b", None]), i % 9, begin, end))
    return queries, spans


@pytest.mark.parametrize("width, hot", [(3600, 10**6), (3600, 10), (86400, 40), (900, 5)])
def test_interval_join(spark, width, hot):
    queries, spans = cases(width, 300)
    q = spark.createDataFrame(queries, "id long, ip string, queried_at timestamp_ntz").repartition(3)
    a = spark.createDataFrame(spans, "ip string, device_id int, observed_from timestamp_ntz, observed_to timestamp_ntz")
    found = Counter((r["id"], r["device_id"]) for r in correlate.interval_join(q, a, width, hot).collect())
    covers = lambda s, t: s[2] <= t and (s[3] is None or s[3] > t)
    assert found == Counter((i, s[1]) for i, ip, t in queries for s in spans if ip is not None and ip == s[0] and covers(s, t))
    pairs = correlate.candidate_pairs(q, a, width).collect()
    assert all(r["pairs"] <= r["whole"] for r in pairs) and (width > 3600 or sum(r["pairs"] for r in pairs) < sum(r["whole"] for r in pairs))
    held = {(r["ip"], r["window"]) for r in correlate.reassigned_addresses(q, a, width).collect()}
    size = dt.timedelta(seconds=width)
    epoch = dt.datetime(1970, 1, 1)
    windows = range(min(int((t - epoch) / size) for _, _, t in queries), max(int((t - epoch) / size) for _, _, t in queries) + 1)
    want = set()
    for k in windows:
        begin, end = epoch + k * size, epoch + (k + 1) * size
        by = {}
        for ip, device, low, high in spans:
            if low < end and (high is None or (high > begin and high > low)):
                by.setdefault(ip, set()).add(device)
        want |= {(ip, k) for ip, devices in by.items() if len(devices) > 1}
    assert {x for x in held if x[0] is not None} == {x for x in want if x[0] is not None}


def test_a_hot_key_is_dealt_over_tasks(spark):
    rows = spark.range(9000).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id % 500 AS STRING)) AS k")
    few = {r["k"]: r["_shares"] for r in skew.hot_keys(rows, ["k"], 100).collect()}
    assert few == {"hot": 30}
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("none", 4)], "k string, v int")
    assert Counter((r["k"], r["v"]) for r in skew.dealt_join(rows, small, ["k"], "id", 100).collect()) == {("hot", 1): 3000, ("hot", 2): 3000, ("7", 3): 12}


def test_no_rows(spark):
    q = spark.createDataFrame([], "id long, ip string, queried_at timestamp_ntz")
    a = spark.createDataFrame([], "ip string, device_id int, observed_from timestamp_ntz, observed_to timestamp_ntz")
    assert correlate.interval_join(q, a).collect() == []


def test_decisions_of_the_known_cases(spark):
    """The moved address, the shared name and the name alone, with each score."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    spans = [("ip1", 1, at(0), None), ("ip2", 2, at(0), at(30)), ("ip2", 3, at(30), None), ("ip3", 4, at(0), None)]
    names = [("tablet", "dns_client", 1, at(0)), ("laptop", "hostname", 4, at(0)), ("other", "dns_client", 9, at(0)), ("alone", "hostname", 5, at(0)), ("client", "dns_client", 6, at(0)), ("late", "hostname", 7, at(50))]
    asked = [(1, "ip1", "tablet"), (2, "ip3", " laptop "), (3, "ip1", ""), (4, "ip1", "other"), (5, "ip2", ""), (6, "none", "alone"), (7, None, "client"), (8, "none", "late"), (9, "none", "")]
    q = spark.createDataFrame([(i, ip, c, at(10)) for i, ip, c in asked], "id long, ip string, client string, queried_at timestamp_ntz")
    a = spark.createDataFrame(spans, "ip string, device_id long, observed_from timestamp_ntz, observed_to timestamp_ntz")
    n = spark.createDataFrame(names, "value string, kind string, device_id long, first_seen timestamp_ntz")
    evidence = correlate.interval_join(q, a).select("id", "device_id").withColumn("kind", correlate.F.lit("ip")).unionByName(correlate.identifier_join(q, n))
    rows = {r["id"]: r for r in correlate.attribution(correlate.windowed(q), evidence, correlate.reassigned_addresses(q, a)).collect()}
    got = {i: (r["status"], r["device_id"], float(r["confidence"])) for i, r in rows.items()}
    none = ("unattributed", None, 0.0)
    assert got == {1: ("attributed", 1, 0.95), 2: ("attributed", 4, 0.9), 3: ("attributed", 1, 0.8), 4: ("ambiguous", None, 0.0), 5: ("ambiguous", None, 0.0), 6: ("unattributed", None, 0.55), 7: ("unattributed", None, 0.6), 8: none, 9: none}
    assert [c["reason"] for c in rows[5]["conflicts"]] == ["ip_reassigned_in_window"] and [c["reason"] for c in rows[4]["conflicts"]] == ["multiple_candidate_devices"]
