"""People over time against a replay of edits, schedules and settings, and recorded files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from homelens import replay
from homelens.operators import health, people
from homelens.sources import ledger

T0 = dt.datetime(2024, 6, 1)
EDIT = "seq long, device_id long, person_id long, action string, at timestamp_ntz"


def drawn(seed, n=250):
    draw = random.Random(seed)
    return [(k, draw.randrange(6), draw.randrange(3), draw.choice(["assign", "assign", "unassign"]), T0 + dt.timedelta(hours=draw.randrange(0, 150))) for k in range(n)]


def replayed(edits):
    spans, now = [], {}
    for seq, device, person, action, at in sorted(edits, key=lambda e: (e[4], e[0])):
        holder = now.get(device)
        if action == "assign" and (holder is None or holder[0] != person):
            if holder:
                spans.append((device, holder[0], holder[1], at))
            now[device] = (person, at)
        elif action == "unassign" and holder and holder[0] == person:
            spans.append((device, person, holder[1], at))
            now[device] = None
    spans += [(d, h[0], h[1], None) for d, h in now.items() if h]
    return sorted((s for s in spans if s[3] is None or s[3] > s[2]), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("device_id", "person_id", "valid_from", "valid_to").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_of_overlapping_edits(spark, seed):
    edits = drawn(seed)
    random.Random(seed).shuffle(edits)
    table = lambda some: spark.createDataFrame(some, EDIT)
    assert rows(people.intervals(table(edits).repartition(3))) == replayed(edits)
    first, second = edits[:170], [e for e in edits[170:] if e[1] < 3]  # late and overlapping, of some devices only
    merged = people.merged_intervals(people.intervals(table(first)), table(first), table(second))
    assert rows(merged) == replayed(first + second)
    asked = [(k, k % 7, T0 + dt.timedelta(hours=k / 2)) for k in range(300)]
    held = people.held_at(spark.createDataFrame(asked, "id long, device_id long, queried_at timestamp_ntz"), merged, hot=20)
    want = sorted((k, p) for k, d, t in asked for dd, p, a, b in replayed(first + second) if d == dd and a <= t and (b is None or t < b))
    assert sorted(map(tuple, held.collect())) == want


def test_no_edits(spark):
    none = spark.createDataFrame([], EDIT)
    assert people.intervals(none).collect() == []


def test_schedules_and_settings(spark):
    schema = "id int, expected_hours_utc array<int>, days_of_week array<int>, device_id long, person_id long"
    table = [(1, [7, 8], [0, 4], 1, None), (2, [7], None, None, None), (3, [], None, 1, None), (4, [24, None], [7], 1, 2), (5, None, [], None, 3)]
    good, bad = people.checked_schedules(spark.createDataFrame(table, schema))
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: list(r["faults"]) for r in bad.collect()} == {
        2: ["one of device and person"], 3: ["no hours"], 4: ["one of device and person", "hours of 0 to 23", "weekdays of 0 to 6"], 5: ["no hours", "weekdays of 0 to 6"],
    }
    defaults = spark.createDataFrame([("stale", 300.0), ("failures", 3.0), ("z", 2.0)], "key string, value double")
    patches = spark.createDataFrame([("stale", 60.0, 1), ("stale", 90.0, 2), ("stale", None, 3), ("z", None, 1), ("other", 1.0, 1)], "key string, value double, version int")
    assert {r["key"]: (r["value"], r["changed"]) for r in people.merged_settings(defaults, patches).collect()} == {"stale": (90.0, True), "failures": (3.0, False), "z": (2.0, False)}


def test_source_loss_over_chunks(spark):
    draw = random.Random(3)
    history = [(f"s{k % 3}", T0 + dt.timedelta(hours=5 * k), k, draw.choice(["ok", "degraded", "down"])) for k in range(200)]
    found = health.status_changes(spark.createDataFrame(history, "source string, checked_at timestamp_ntz, id int, status string"), 86400, tie="id")
    want = []
    for s in ("s0", "s1", "s2"):
        mine = [h for h in history if h[0] == s]
        want += [b for a, b in zip(mine, mine[1:]) if b[3] == "down" and a[3] != "down"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_recorded_files_count_once(spark, tmp_path):
    store = str(tmp_path / "store")
    dns = tmp_path / "dns.json"
    query = lambda i: {"id": i, "time": 1721740800.5 + i, "type": "A", "status": "GRAVITY", "domain": "ads.example", "client": {"ip": "10.0.0.2", "name": None}}
    dns.write_text(json.dumps({"queries": [query(1), query(2)]}))
    lines = tmp_path / "lines.log"
    lines.write_text("# comment\n\nplain text\nEVT_WU_Connected: User[aa:bb:cc:dd:ee:03] SSID[home]\n")
    run = lambda kind, path, name: replay.replay(spark, kind, str(path), store, name, "2024-07-23 13:00:00")
    assert run("dns", dns, "dns-1") and run("dns", dns, "dns-1") and run("syslog", lines, "lines-1")
    assert not run("controller", tmp_path / "missing", "controller-1")
    dns.write_text(json.dumps({"queries": [query(3), {"id": 4}]}))
    assert not run("dns", dns, "dns-2")
    status = {r["batch_id"]: (r["status"], r["records"]) for r in ledger.batches(spark, store).collect()}
    assert status == {"dns-1": ("succeeded", 2), "lines-1": ("succeeded", 2), "controller-1": ("failed", 0), "dns-2": ("failed", 0)}
    kept = ledger.rows(spark, store, replay.ROW)
    assert {r["kind"]: r["n"] for r in kept.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"query": 2, "line": 2}
    assert sorted(json.loads(r["row"])["source_id"] for r in kept.filter("kind = 'query'").collect()) == ["1", "2"]
