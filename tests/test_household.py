"""Small cases with known outcomes, and brute force for spans."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from homelens.functions import normalize as N
from homelens.operators import activity, baseline, correlate, dashboard, feedback, findings, health, identity
from homelens.sources import controller, dns_log, syslog
from homelens.streaming import live

T0 = datetime(2024, 1, 1)


def one(df):
    return df.collect()[0]


def test_patterns(spark):
    rows = spark.createDataFrame([([],), (["Ads.Example.com."],), (["a.example.com", "b.example.com"],), (["a.example.com", "b.other.org"],)], "d array<string>")
    assert [r[0] for r in rows.select(feedback.domain_pattern(F.col("d"))).collect()] == ["*", "ads.example.com", "*.example.com", "*"]


def test_baseline_values(spark):
    rows = spark.createDataFrame([(1, x) for x in (10.0, 20.0, 30.0)] + [(2, 50.0)], "k int, value double")
    got = {r["k"]: r for r in baseline.metric_baseline(rows, ["k"]).collect()}
    assert (got[1]["mean"], got[1]["stddev"], got[1]["p95"], got[1]["high_threshold"]) == (20, 10, 30, 40)
    assert (got[2]["stddev"], got[2]["p95"]) == (0, 50)
    live_values = spark.createDataFrame([(1, 100.0), (2, 51.0)], "k int, value double")
    kinds = {r["k"]: r["kind"] for r in baseline.deviations(live_values, baseline.metric_baseline(rows, ["k"]), ["k"]).collect()}
    assert kinds == {1: "z_score", 2: "above_constant_mean"}


def test_window_border_counts_twice(spark):
    rows = spark.createDataFrame([(1, 1, datetime(2024, 1, 30), "a.example", "allowed"), (2, 1, datetime(2024, 1, 30, 12), "A.example.", "blocked")], "id int, device_id int, queried_at timestamp_ntz, domain string, status string")
    got = {r["idx"]: r for r in baseline.window_samples(rows, "2024-01-31 00:00:00").collect()}
    assert (got[0]["dns_query_volume"], got[1]["dns_query_volume"], got[0]["unique_domain_count"]) == (2, 1, 1)
    assert (got[0]["new_domain_count"], got[1]["new_domain_count"]) == (1, 1)


def test_window_summary(spark):
    rows = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), "example.com", "allowed"), (2, 1, datetime(2024, 1, 24), "example.com", "allowed"), (3, 1, datetime(2024, 1, 24, 0, 5), "ads.example", "blocked")], "id int, device_id int, queried_at timestamp_ntz, domain string, status string")
    r = one(activity.dns_window_summary(rows, "2024-01-24 00:00:00", "2024-01-25 00:00:00"))
    assert (r["dns_query_volume"], r["blocked_query_pct"], r["unique_domain_count"], r["new_domain_count"], r["active_hour_count"]) == (2, 50.0, 2, 1, 1)


def test_spans_equal_two_pointers(spark):
    draw = random.Random(5)
    data = [(k, i, T0 + timedelta(minutes=draw.randrange(0, 200, 5))) for k in range(12) for i in range(draw.randrange(1, 15))]
    rows = spark.createDataFrame(data, "k int, id int, ts timestamp_ntz")
    got = {r["k"]: (r["n"], r["first"], r["last"]) for r in findings.burst_spans(rows, "k", "ts", "id", 900, 3).collect()}
    want = {}
    for k in range(12):
        times, left, best = sorted(t for q, _, t in data if q == k), 0, None
        for right, t in enumerate(times):
            while (t - times[left]).total_seconds() > 900:
                left += 1
            if best is None or right - left + 1 > best[0]:
                best = (right - left + 1, times[left], t)
        if best[0] >= 3:
            want[k] = best
    assert got == want


def test_attribution_table(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d")], "id int, ip string")
    evidence = spark.createDataFrame([(1, 7, "ip"), (1, 7, "dns_client"), (2, 7, "ip"), (2, 8, "dns_client"), (3, 7, "hostname"), (5, 9, "ip")], "id int, device_id int, kind string")
    moved = spark.createDataFrame([("d",)], "ip string")
    got = {r["id"]: (r["status"], r["device_id"], float(r["confidence"])) for r in correlate.attribution(queries, evidence, moved).collect()}
    assert got == {1: ("attributed", 7, 0.95), 2: ("ambiguous", None, 0.0), 3: ("unattributed", None, 0.55), 4: ("unattributed", None, 0.0), 5: ("ambiguous", None, 0.0)}


def test_devices_never_merge(spark):
    rows = spark.createDataFrame([(1, "m1", "u1"), (2, "m2", "u2"), (3, "m1", "u2"), (4, None, "u2"), (5, None, None), (6, None, None)], "seq long, mac string, controller_id string")
    got = {r["seq"]: r["device_seq"] for r in identity.resolve_devices(rows).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 6}


def test_ip_history_closes_runs(spark):
    rows = spark.createDataFrame([(1, 1, ".40", T0), (2, 1, ".40", T0 + timedelta(minutes=5)), (3, 1, ".99", T0 + timedelta(hours=1))], "id int, device_id int, ip string, observed_at timestamp_ntz")
    got = [(r["ip"], r["observed_to"]) for r in identity.ip_history(rows).orderBy("observed_from").collect()]
    assert got == [(".40", T0 + timedelta(hours=1)), (".99", None)]


def test_source_status(spark):
    now = "2024-01-01 01:00:00"
    at = datetime(2024, 1, 1, 1)
    rows = spark.createDataFrame([("fresh", at - timedelta(seconds=30), True), ("stale", at - timedelta(seconds=601), True), *[("bad", at - timedelta(seconds=i), False) for i in (1, 2, 3)], ("bad", at - timedelta(seconds=60), True)], "source string, tried_at timestamp_ntz, ok boolean")
    got = {r["source"]: r["status"] for r in health.all_sources(health.source_health(rows, now), ("fresh", "stale", "bad", "never")).collect()}
    assert got == {"fresh": "ok", "stale": "degraded", "bad": "down", "never": "down"}


def test_dns_envelope(spark):
    texts = spark.createDataFrame([('{"queries": [{"id": 1001, "time": 1721740800.125, "type": "A", "status": "FORWARDED", "domain": "example.com", "client": {"ip": "192.168.1.50", "name": "tablet"}}, {"id": 2, "time": 1721740801, "status": "GRAVITY", "domain": "ads.example", "client": {"ip": "192.168.1.20", "name": null}}, [1, 2]]}',)], "value string")
    rows = dns_log.normalize_queries(dns_log.envelope_rows(texts)).collect()
    assert [(r["status"], r["client_identifier"], r["error"]) for r in rows] == [("allowed", "tablet", None), ("blocked", "192.168.1.20", None), ("allowed", None, "legacy row")]
    assert rows[0]["queried_at"].microsecond == 125000


def test_batch_with_a_bad_row_fails(spark, tmp_path):
    rows = dns_log.normalize_queries(spark.createDataFrame([('{"id": 1, "time": 1, "domain": "a", "client": "x"}',), ('{"id": 2}',)], "payload string"))
    import pytest

    with pytest.raises(ValueError):
        dns_log.append_batch(rows, str(tmp_path / "dns"))
    assert dns_log.append_batch(rows, str(tmp_path / "dns"), on_error="quarantine") == 1


def test_controller_rows(spark):
    client = '{"_id": "c1", "mac": "AA:BB:CC:DD:EE:01", "hostname": "tablet", "ip": "192.168.1.50", "first_seen": 1721740800000, "last_seen": 1721740700, "tx_bytes": 10, "rx_bytes": 20, "is_wired": false}'
    r = one(controller.normalize_clients(spark.createDataFrame([(client,)], "payload string"), "2024-08-01"))
    assert (r["mac"], r["download_bytes"], r["upload_bytes"]) == ("aa:bb:cc:dd:ee:01", 10, 20) and r["first_seen"] <= r["last_seen"]
    e = one(controller.normalize_events(spark.createDataFrame([('{"_id": "e", "key": "EVT_WU_Disconnected", "time": 1721740790, "datetime": "2024-07-23T12:00:00Z"}',)], "payload string"), "2024-08-01"))
    assert e["kind"] == "disconnect" and e["seen_at"] == datetime(2024, 7, 23, 13, 19, 50)


LINES = [
    "<14>Jul 23 13:20:00 gw CEF:0|Ubiquiti|UniFi Network|8.2|400|WiFi Client Connected|1|UNIFIcategory=Monitoring UNIFIclientMac=AA:BB:CC:DD:EE:01 UNIFIclientIp=192.168.1.50 UNIFIwifiName=Home\\=Wifi UNIFIclientHostname=tablet msg=joined the network",
    '<4>Jul 23 13:20:01 gw kernel: [WAN_LOCAL-D-DEFAULT-A] DESCR="drop all" IN=eth0 SRC=198.51.100.9 DST=203.0.113.4 PROTO=TCP',
    "EVT_WU_Connected: User[aa-bb-cc-dd-ee-03] has connected to AP[aa:bb:cc:dd:ee:ff] SSID[KidsWifi]",
    "nothing known here",
]


def test_syslog_formats(spark):
    got = syslog.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    assert [r["format"] for r in got] == ["cef", "firewall", "event", None]
    cef, fire, event, _ = got
    assert (cef["event_name"], cef["category"], cef["mac"], cef["client_ip"], cef["ssid"], cef["hostname"], cef["msg"], cef["pri"]) == ("WiFi Client Connected", "Monitoring", "aa:bb:cc:dd:ee:01", "192.168.1.50", "Home=Wifi", "tablet", "joined the network", 14)
    assert (fire["event_name"], fire["category"], fire["client_ip"], fire["dst_ip"], fire["proto"], fire["msg"]) == ("WAN_LOCAL-D-DEFAULT-A", "Security", "198.51.100.9", "203.0.113.4", "TCP", "drop all")
    assert (event["event_name"], event["category"], event["sub_category"], event["mac"], event["ssid"], event["ap_mac"]) == ("EVT_WU_Connected", "Monitoring", "WiFi", "aa:bb:cc:dd:ee:03", "KidsWifi", "aa:bb:cc:dd:ee:ff")


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.log").write_text("\n".join(LINES[:2]) + "\n# note\n")
    for more in (None, LINES[2]):
        if more:
            (source / "b.log").write_text(more + "\n")
        live.append_stream(live.stream_lines(spark, str(source)).select("value", "format"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(r["format"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["cef", "event", "firewall"]


def test_upsert_keeps_closed_findings(spark):
    drafts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "fingerprint string, n int")
    old = spark.createDataFrame([("a", "dismissed"), ("b", "acknowledged")], "fingerprint string, status string")
    got = {r["fingerprint"]: (r["status"], r["created"]) for r in feedback.finding_upsert(drafts, old).collect()}
    assert got == {"b": ("acknowledged", False), "c": ("open", True)}


def test_reassigning_a_device_closes_the_other_link(spark):
    links = spark.createDataFrame([(1, 5, "parent", T0, True, 1)], "person_id long, device_id long, assigned_by string, assigned_at timestamp_ntz, active boolean, version long")
    new = feedback.assign_device(links, 2, 5, "parent", "2024-02-01 00:00:00")
    assert sorted((r["person_id"], r["active"]) for r in new.collect()) == [(1, False), (2, True)]
    assert feedback.assign_device(links, 1, 5, "parent", "2024-02-01 00:00:00").count() == 0


def test_down_sources_come_before_attention(spark):
    items = spark.createDataFrame([(0, "x", "x is down")], "tier int, item string, summary string")
    up = spark.createDataFrame([("a", "ok")], "source string, status string")
    count = spark.createDataFrame([(1,)], "n int")
    assert one(dashboard.household_status(up, items, count))["reason"] == "x is down"
    assert one(dashboard.household_status(up.withColumn("status", F.lit("down")), items, count))["status"] == "incomplete"


def test_numbers_and_claims(spark):
    df = spark.createDataFrame([(100.0, "I read it"), (12.3456789, "already"), (0.00123, None)], "x double, t string")
    assert [r[0] for r in df.select(N.general_number(F.col("x"))).collect()] == ["100", "12.3457", "0.00123"]
    assert [r[0] for r in df.select(N.claims_content(F.col("t"))).collect()] == [True, False, False]
