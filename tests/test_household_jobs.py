"""Household queries do the whole job: compared with brute force and with their SQL without its id filter."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest

from homelens.operators import health, identity
from homelens.plans import registry

DATA = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the generated tables")


def duck(sql):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con.execute(sql).fetchall()


@needs_tables
@pytest.mark.parametrize("name", ["source_health_status", "source_health_all", "incomplete_sources", "system_status", "household_status"])
def test_health_covers_every_source(spark, name):
    cut = " WHERE device_id <= 6"
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(duck(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name].replace(cut, '')})"))
    if name == "source_health_status":
        assert got.count() == duck("SELECT count(DISTINCT user_id) FROM events")[0][0] > 7


def test_failures_since_the_last_success(spark):
    draw = random.Random(3)
    tries = [(s, T0 + timedelta(seconds=draw.randrange(40)), draw.random() < 0.2) for s in "abcdef" for _ in range(draw.randrange(1, 30))]
    tries += [("hot", T0 + timedelta(seconds=i), False) for i in range(500)]
    want = {}
    for s in {t[0] for t in tries}:
        good = max((t for q, t, ok in tries if q == s and ok), default=None)
        want[s] = (good, sum(q == s and not ok and (good is None or t > good) for q, t, ok in tries))
    found = health.source_health(spark.createDataFrame(tries, "source string, tried_at timestamp_ntz, ok boolean"), "2024-01-02 00:00:00")
    assert {r["source"]: (r["last_success_at"], r["consecutive_failures"]) for r in found.collect()} == want
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_every_lookup_is_attributed_from_all_evidence(spark):
    rows = []
    for i, ts, device, k in duck("SELECT event_id, ts, user_id, regexp_extract(props, '[0-9]+')::INTEGER FROM events ORDER BY event_id"):
        own = f"a{device}.{ts.day // 10}"
        client = {0: f"c{device}", 1: f"h{device}", 2: f"x{device % 7}", 3: ""}[k % 4]
        rows.append((i, ts, device, f"s{k}" if k < 15 else own, f"s{k * 7 % 15}" if k < 15 else own, client, "hostname" if k % 4 else "dns_client"))
    runs = []
    for device in {r[2] for r in rows}:
        last = None
        for _, ts, _, _, seen, _, _ in sorted((r for r in rows if r[2] == device), key=lambda r: (r[1], r[0])):
            if last is None or last[0] != seen:
                if last:
                    last[3] = ts
                last = [seen, device, ts, None]
                runs.append(last)
    holders: dict = {}
    days = sorted({r[1].date() for r in rows})
    for ip, device, since, until in runs:
        for day in days:
            begin = datetime.combine(day, datetime.min.time())
            if since < begin + timedelta(days=1) and (until is None or until > begin):
                holders.setdefault((ip, day), set()).add(device)
    owner, since_of = {}, {}
    for _, ts, device, _, _, client, kind in rows:
        if client and owner.setdefault((kind, client), device) == device:
            since_of[kind, client] = min(ts, since_of.get((kind, client), ts))
    want, by_address = {}, []
    for i, ts, _, ip, _, client, _ in rows:
        found = {("ip", device) for a, device, since, until in runs if a == ip and since <= ts and (until is None or until > ts)}
        by_address += [(i, device) for _, device in found]
        found |= {(kind, owner[kind, client]) for kind in ("dns_client", "hostname") if (kind, client) in owner and since_of[kind, client] <= ts}
        devices, kinds = {x for _, x in found}, {x for x, _ in found}
        if len(devices) > 1 or len(holders.get((ip, ts.date()), ())) > 1:
            want[i] = ("ambiguous", None, 0.0)
            continue
        score = 0.95 if {"ip", "dns_client"} <= kinds else 0.9 if {"ip", "hostname"} <= kinds else 0.8 if "ip" in kinds else 0.6 if "dns_client" in kinds else 0.55 if kinds else 0.0
        want[i] = ("attributed", min(devices), score) if score >= 0.7 else ("unattributed", None, score)
    assert {x[2] for x in want.values()} == {0.0, 0.55, 0.6, 0.8, 0.9, 0.95}
    got = {r["id"]: (r["status"], r["device_id"], r["confidence"]) for r in registry.QUERIES["attribution"](spark, DATA).collect()}
    assert got == want and len(got) == len(rows)
    assert {x[0] for x in want.values()} == {"attributed", "ambiguous", "unattributed"}
    queued = {i: x[0] for i, x in want.items() if x[0] != "attributed"}
    assert dict(map(tuple, registry.QUERIES["review_queue"](spark, DATA).collect())) == queued
    assert registry.QUERIES["review_count"](spark, DATA).first()["n"] == len(queued)
    assert set(map(tuple, registry.QUERIES["interval_join"](spark, DATA).collect())) == set(by_address)


@needs_tables
def test_identifier_join_takes_every_lookup(spark):
    got = sorted(map(tuple, registry.QUERIES["identifier_join"](spark, DATA).select("id", "kind", "device_id").collect()))
    assert got == sorted(duck(registry.ORACLES["identifier_join"])) and len(got) > 100


def replayed(rows):
    macs, ids, found = {}, {}, {}
    for seq, mac, cid in sorted(rows):
        device = macs.get(mac, ids.get(cid, seq))
        if mac is not None:
            macs.setdefault(mac, device)
        if cid is not None:
            ids.setdefault(cid, device)
        found[seq] = device
    return found


def test_devices_of_long_chains_and_hot_macs(spark):
    forth = [(k, f"m{k // 2}", f"u{(k + 1) // 2}") for k in range(51)]
    back = [(200 - k, f"b{k // 2}", f"v{(k + 1) // 2}") for k in range(51)]
    hot = [(1000 + k, "hot", None if k % 3 == 0 else f"h{k % 40}") for k in range(600)]
    nameless = [(2000 + k, None, f"h{k % 60}") for k in range(90)] + [(3000 + k, f"m{k}", None) for k in range(60)]
    lone = [(4000 + k, None, None) for k in range(5)]
    draw = random.Random(9)
    mixed = [(5000 + k, draw.choice([None, *(f"x{j}" for j in range(40))]), draw.choice([None, *(f"y{j}" for j in range(40))])) for k in range(400)]
    for data in ([*forth, *lone], [*forth, *back, *hot, *nameless, *mixed, *lone]):
        rows = spark.createDataFrame(data, "seq long, mac string, controller_id string")
        got = [(r["seq"], r["device_seq"]) for r in identity.resolve_devices(rows).collect()]
        assert len(got) == len(data) and dict(got) == replayed(data)
    assert {replayed(forth)[k] for k in range(51)} == {0}


@needs_tables
def test_all_seven_rules_are_evaluated(spark):
    rules = {"blocked_query_burst": "rule_blocked_burst", "new_domain_burst": "rule_new_domains", "unknown_device_online": "rule_unknown_device", "connection_flapping": "rule_flapping", "dns_volume_increase": "rule_volume", "activity_outside_expected_hours": "rule_outside_hours", "controller_security_event": "rule_security"}
    want = []
    for rule, name in rules.items():
        sql = registry.ORACLES[name].replace("SELECT id FROM findings", "SELECT device_id FROM findings")
        want += [(rule, r[0]) for r in duck(f"SELECT device_id FROM ({sql})")]
    assert sorted(map(tuple, registry.QUERIES["evaluate_rules"](spark, DATA).select("rule_id", "device_id").collect())) == sorted(want)
    assert len({r for r, _ in want}) >= 4


@needs_tables
def test_the_review_queue_wants_attention(spark):
    found = registry.QUERIES["attention_items"](spark, DATA)
    analyzed = found._jdf.queryExecution().analyzed().toString()
    assert "needs_review" in analyzed and registry.QUERIES["review_count"](spark, DATA).first()["n"] > 0
    assert [r["tier"] for r in found.collect()] == sorted(r["tier"] for r in found.collect())
