"""Queries of stored batches, streams and loops over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homelens.functions import normalize as N
from homelens.operators import activity, baseline, changes, feedback, health, identity, panes, people
from homelens.plans import registry
from homelens.plans import views as V
from homelens.plans.registry import NOW, query
from homelens.session import shared_folder
from homelens.sources import dns_log, keyset, ledger
from homelens.streaming import attribution, finding_loop, keyed

STORED = "source_id string, domain string, status string"


def _ingested(s: SparkSession, d: str) -> str:
    """Lookups as payloads in three batches: one written twice, one that fails first, one that only fails."""
    path = shared_folder(s, "ingest")
    lookups = V.lookups(s, d)
    code = F.when(F.col("status") == "blocked", "GRAVITY").when(F.col("status") == "cached", "CACHE").otherwise("FORWARDED")

    def batch(k: int, bad: bool) -> DataFrame:
        domain = F.when(F.lit(bad) & (F.col("id") % 300 == k), F.lit(None)).otherwise(F.col("domain"))
        payload = F.to_json(F.struct("id", F.unix_timestamp(F.col("queried_at").cast("timestamp")).alias("time"), domain.alias("domain"), code.alias("status"), F.struct(F.col("device_id").cast("string").alias("ip")).alias("client")))
        return dns_log.normalize_queries(lookups.filter(F.col("id") % 3 == k).select(payload.alias("payload"))).select("source_id", "domain", "status", "error")

    for k, bad in ((0, False), (0, False), (1, True), (1, False), (2, True)):
        ledger.append(batch(k, bad), path, f"batch-{k}", "dns_log", NOW)
    return path


@query("ingest_rows", "SELECT id, domain, status, 'batch-' || id % 3 AS batch_id FROM lookups WHERE id % 3 <> 2")
def _(s, d):
    rows = ledger.rows(s, _ingested(s, d), STORED)
    return rows.select(F.col("source_id").cast("long").alias("id"), N.normalize_domain(F.col("domain")).alias("domain"), "status", "batch_id")


@query(
    "ingest_batches",
    """SELECT 'batch-' || id % 3 AS batch_id, CASE WHEN id % 3 = 2 THEN 'failed' ELSE 'succeeded' END AS status,
    CASE WHEN id % 3 = 2 THEN 0 ELSE count(*) END::BIGINT AS records, CASE WHEN id % 3 = 2 THEN 'no domain' END AS error FROM lookups GROUP BY id % 3""",
)
def _(s, d):
    return ledger.batches(s, _ingested(s, d)).select("batch_id", "status", "records", "error")


def _slices(folder: str, rows: DataFrame, column: str, cuts: list[str]) -> Iterator[None]:
    """Append ``rows`` to ``folder`` one slice of time after the other, each by as many tasks as it is read by."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.filter(F.col(column) >= at(low))
        yield (part if high is None else part.filter(F.col(column) < at(high))).write.mode("append").parquet(folder)


CUTS = ["2024-01-10 00:00:00", "2024-01-20 00:00:00"]
ATTEMPT = "source string, tried_at timestamp_ntz, ok boolean"


def _health_stream(s: SparkSession, d: str) -> DataFrame:
    """Health after each of three slices of all sources' attempts, read as a stream."""
    folder, out, marks = (shared_folder(s, x) for x in ("attempts", "health", "health-marks"))
    for _ in _slices(folder, registry.attempts(s, d), "tried_at", CUTS):
        stream = s.readStream.schema(ATTEMPT).parquet(folder)  # a slice is a batch, whatever its files
        keyed.source_health(stream, 90000, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(keyed.HEALTH).parquet(out)


@query("source_health_stream", f", {registry.HEALTH_SQL} SELECT source, consecutive_failures, good AS last_success_at FROM judged JOIN (SELECT source, good FROM health) USING (source)")
def _(s, d):
    last = _health_stream(s, d).filter("went_down_at IS NULL").groupBy("source").agg(F.max_by(F.struct("consecutive_failures", F.col("last_success_at").cast("timestamp_ntz").alias("last_success_at")), "attempts").alias("r"))
    return last.select("source", "r.*")


@query(
    "source_down_events",
    """, tries AS (SELECT device_id::VARCHAR AS source, queried_at, id, status <> 'blocked' AS ok FROM lookups),
    runs AS (SELECT *, max(queried_at) FILTER (ok) OVER w AS good, count(*) FILTER (ok) OVER w AS run FROM tries WINDOW w AS (PARTITION BY source ORDER BY queried_at, id)),
    streaks AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY source, run ORDER BY queried_at, id) AS failures FROM runs),
    states AS (SELECT *, good IS NULL OR failures >= 3 AS down FROM streaks)
    SELECT source, queried_at AS went_down_at FROM (SELECT *, lag(down) OVER (PARTITION BY source ORDER BY queried_at, id) AS before FROM states) WHERE down AND NOT before""",
)
def _(s, d):
    return _health_stream(s, d).filter("went_down_at IS NOT NULL").select("source", F.col("went_down_at").cast("timestamp_ntz").alias("went_down_at"))


@query("keyset_stream", "SELECT id, severity, occurred_at FROM findings")
def _(s, d):
    """All findings, read as a stream by (occurred_at, id) in pages of a third of the table, over a restart."""
    rows = V.findings(s, d).select("id", "severity", "occurred_at")
    folder, out, marks = (shared_folder(s, x) for x in ("events", "event-pages", "event-marks"))
    rows.write.parquet(folder)
    keyset.register(s)
    options = {"path": folder, "created": "occurred_at", "id": "id", "rows": str(max(1, rows.count() // 3 + 1)), "mark": f"{folder}.mark"}
    for _ in range(2):
        stream = s.readStream.format(keyset.FORMAT).schema(rows.schema).options(**options).load()
        running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
    return s.read.schema(rows.schema).parquet(out)


WEEKS = ["2024-01-17 00:00:00", "2024-01-24 00:00:00"]
SPAN = {"2024-01-17 00:00:00": "2024-01-10 00:00:00", "2024-01-24 00:00:00": "2024-01-17 00:00:00", NOW: V.START}


def _found(s: SparkSession, d: str) -> finding_loop.FindingStore:
    """All seven rules on a stream of lookups, a week at a time: each batch is judged with all lookups before its end."""
    lookups = V.lookups(s, d)
    folder, marks = shared_folder(s, "lookups"), shared_folder(s, "finding-marks")
    store = finding_loop.FindingStore(s, shared_folder(s, "findings"))

    def evaluate(batch: DataFrame, number: int) -> DataFrame:
        last = batch.agg(F.max("queried_at")).first()[0]
        now = next(t for t in sorted(SPAN) if t > str(last)) if str(last) < NOW else NOW
        upto = s.read.schema(lookups.schema).parquet(folder).filter(F.col("queried_at") < F.lit(now).cast("timestamp_ntz"))
        return registry.drafts_at(s, d, upto, SPAN[now], now)

    for _ in _slices(folder, lookups, "queried_at", WEEKS):
        stream = s.readStream.schema(lookups.schema).parquet(folder)  # a slice is a batch, whatever its files
        finding_loop.start(stream, store, evaluate, marks, None).awaitTermination()
    return store


def _at(now: str) -> str:
    """The SQL of the drafts as of ``now``."""
    whole = V.SQL + f", {registry.DRAFTS_SQL} SELECT rule_id, device_id FROM drafts"
    upto = f"FROM (SELECT * FROM events WHERE ts < TIMESTAMP '{now}')"
    return whole.replace(NOW, "@now").replace(V.START, "@start").replace("FROM events", upto).replace("@now", now).replace("@start", SPAN[now])


_FOUND = " UNION ".join(f"SELECT * FROM ({_at(now)})" for now in SPAN)


@query("finding_loop", lambda: f", looped AS ({_FOUND}) SELECT DISTINCT rule_id, device_id FROM looped")
def _(s, d):
    return _found(s, d).findings().select("rule_id", "device_id").distinct()


@query(
    "feedback_write",
    f""", {registry.DRAFTS_SQL},
    said AS (SELECT * FROM drafts WHERE rule_id <> 'controller_security_event' AND device_id % 2 = 0)
    SELECT 'finding' AS kind, rule_id, device_id, CASE device_id % 3 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'acknowledged' ELSE 'resolved' END AS status FROM said
    UNION ALL SELECT 'suppression', rule_id, device_id, 'dismissed' FROM said WHERE device_id % 3 = 0""",
)
def _(s, d):
    current = registry.drafts_at(s, d, V.lookups(s, d), V.START, NOW).filter("rule_id <> 'controller_security_event' AND device_id % 2 = 0").withColumn("status", F.lit("open")).withColumn("created", F.lit(False))
    by = F.when(F.col("device_id") % 3 == 0, "suppress_similar").when(F.col("device_id") % 3 == 1, "concerning").otherwise("resolve")
    none = s.createDataFrame([], "matching_key string")
    return feedback.feedback_write(current.select("fingerprint", by.alias("classification")), current, none).filter("kind <> 'audit'").select("kind", "rule_id", "device_id", "status")


def _weeks(s: SparkSession, d: str) -> list[DataFrame]:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = V.lookups(s, d)
    return [rows.filter(F.col("queried_at") < at(WEEKS[0])), rows.filter((F.col("queried_at") >= at(WEEKS[0])) & (F.col("queried_at") < at(WEEKS[1]))), rows.filter((F.col("queried_at") >= at(WEEKS[1])) & (F.col("queried_at") <= at(NOW)))]


@query("first_seen_index", "SELECT device_id, domain, first_seen FROM first_seen WHERE first_seen >= TIMESTAMP '2024-01-24 00:00:00'")
def _(s, d):
    """New domains of the last window against an index that the windows before it have built."""
    folder = shared_folder(s, "first-seen")
    index = panes.FirstSeen(s, "first_seen_" + folder[-32:], folder, 16)
    for week in _weeks(s, d):
        fresh = index.extend(week)
    return fresh


def _panes(s: SparkSession, d: str) -> panes.Panes:
    kept = panes.Panes(s, shared_folder(s, "panes"))
    for k, week in enumerate([*_weeks(s, d), _weeks(s, d)[-1]]):  # the last one twice
        kept.add(week, f"week-{min(k, 2)}")
    return kept


@query("pane_samples", "SELECT device_id, idx, dns_query_volume, blocked_query_pct, unique_domain_count, new_domain_count, active_hour_count FROM samples")
def _(s, d):
    return _panes(s, d).samples(NOW).drop("hours")


@query("pane_baseline", "SELECT * FROM volume_baseline")
def _(s, d):
    samples = _panes(s, d).samples(NOW)
    return baseline.metric_baseline(samples.select("device_id", F.col("dns_query_volume").cast("double").alias("value")), ["device_id"])


_EDITS = """edits AS (
    SELECT id AS seq, device_id, id % 5 AS person_id, queried_at AS made, CASE WHEN id % 4 = 0 THEN 'unassign' ELSE 'assign' END AS action FROM lookups
), given AS (
    SELECT *, last_value(CASE WHEN action = 'assign' THEN person_id END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY made, seq) AS holder FROM edits
), effective AS (
    SELECT *, CASE WHEN action = 'assign' THEN person_id ELSE -1 END AS state FROM given WHERE action = 'assign' OR person_id = holder
), turns AS (
    SELECT *, lag(state) OVER (PARTITION BY device_id ORDER BY made, seq) AS before FROM effective
), spans AS (
    SELECT device_id, state AS person_id, made AS valid_from, lead(made) OVER (PARTITION BY device_id ORDER BY made, seq) AS valid_to FROM turns WHERE before IS NULL OR before <> state
), held AS (SELECT * FROM spans WHERE person_id >= 0)"""


def _edits(s: SparkSession, d: str) -> DataFrame:
    """An edit for each lookup: its device is given to one of five people, or taken from one."""
    action = F.when(F.col("id") % 4 == 0, people.UNASSIGN).otherwise(people.ASSIGN)
    return V.lookups(s, d).select(F.col("id").alias("seq"), "device_id", (F.col("id") % 5).alias("person_id"), F.col("queried_at").alias("at"), action.alias("action"))


@query("assignment_intervals", f", {_EDITS} SELECT device_id, person_id, valid_from, valid_to FROM held")
def _(s, d):
    """Intervals of a first half of the edits, merged with the other half."""
    edits = _edits(s, d)
    early, late = edits.filter("seq % 2 = 0"), edits.filter("seq % 2 = 1")
    return people.merged_intervals(people.intervals(early), early, late)


@query("held_at", f", {_EDITS} SELECT l.id, h.person_id FROM lookups l JOIN held h ON h.device_id = l.device_id AND h.valid_from <= l.queried_at AND (h.valid_to IS NULL OR h.valid_to > l.queried_at)")
def _(s, d):
    return people.held_at(V.lookups(s, d), people.intervals(_edits(s, d)))


@query(
    "people_devices",
    f""", {_EDITS} SELECT p.person_id, p.name, coalesce(string_agg(d.display_name || ':' || h.device_id, ',' ORDER BY d.display_name, h.device_id), '') AS devices
    FROM people p LEFT JOIN (SELECT * FROM held WHERE valid_to IS NULL) h ON h.person_id = p.person_id LEFT JOIN devices d ON d.device_id = h.device_id GROUP BY 1, 2""",
)
def _(s, d):
    nested = people.with_devices(V.people(s, d), people.intervals(_edits(s, d)), V.devices(s, d))
    told = F.array_join(F.transform("devices", lambda x: F.concat(x["display_name"], F.lit(":"), x["device_id"].cast("string"))), ",")
    return nested.select("person_id", "name", told.alias("devices"))


@query(
    "schedule_faults",
    """SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'one of device and person' END, CASE WHEN c_custkey % 5 = 0 THEN 'no hours' END,
    CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 = 0 THEN 'hours of 0 to 23' END, CASE WHEN c_custkey % 11 = 0 THEN 'weekdays of 0 to 6' END], lambda x: x IS NOT NULL), ', ') AS faults
    FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0""",
)
def _(s, d):
    key = F.col("c_custkey")
    hours = F.when(key % 5 == 0, F.array().cast("array<int>")).when(key % 7 == 0, F.array(F.lit(8), F.lit(24))).otherwise(F.array(F.lit(8)))
    both = F.when(key % 2 == 0, key)
    rows = V.table(s, d, "customer").select(key.alias("id"), hours.alias("expected_hours_utc"), F.when(key % 11 == 0, F.array(F.lit(7))).alias("days_of_week"), F.when(key % 3 == 0, both).otherwise(key).alias("device_id"), F.when(key % 3 == 0, both).alias("person_id"))
    return people.checked_schedules(rows)[1].select("id", F.array_join("faults", ", ").alias("faults"))


@query(
    "settings_merge",
    """SELECT 'k' || n AS key, coalesce(v, n * 1.0::DOUBLE) AS value, v IS NOT NULL AS changed FROM (SELECT n_nationkey AS n FROM nation)
    LEFT JOIN (SELECT c_nationkey AS k, arg_max(c_acctbal, c_custkey) AS v FROM customer WHERE c_acctbal >= 0 AND c_nationkey % 2 = 0 GROUP BY 1) ON k = n""",
)
def _(s, d):
    defaults = V.table(s, d, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.col("n_nationkey").cast("double").alias("value"))
    patches = V.table(s, d, "customer").filter("c_nationkey % 2 = 0").select(F.concat(F.lit("k"), "c_nationkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("value"), F.col("c_custkey").alias("version"))
    return people.merged_settings(defaults, patches)


@query("new_device_events", f", {registry.RESOLVED_SQL} SELECT r.seq AS device_seq, 'new_device' AS kind, o.mac IS NULL AND o.controller_id IS NULL AS is_unknown FROM resolved r JOIN observed o ON o.seq = r.seq WHERE r.seq = r.device_seq")
def _(s, d):
    return identity.new_devices(identity.resolve_devices(registry.observed(s, d)))


@query("baseline_rows", f", {registry.LONG_SQL} SELECT device_id, metric, count(*) AS sample_count, round(avg(value), 6) AS mean, round(avg(value) + 2 * coalesce(stddev_samp(value), 0), 6) AS high_threshold FROM long WHERE value IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    """Baselines written as history and read back."""
    path = shared_folder(s, "baselines")
    full = baseline.metric_baseline(activity.metric_unpivot(registry.eight(s, d).drop("idx")), ["device_id", "metric"])
    history = changes.baseline_history(full, "24h", NOW)
    history.write.parquet(path)
    return changes.baseline_rows(s.read.schema(history.schema).parquet(path)).select("device_id", "metric", "sample_count", "mean", "high_threshold")


@query(
    "uplink_names",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN a.s_name END AS ap_name, w.s_name AS switch_name
    FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey % 200 LEFT JOIN supplier w ON w.s_suppkey = c_custkey % 7""",
)
def _(s, d):
    mac = lambda x: N.normalize_mac(F.lpad(F.hex(x), 12, "0"))
    key = F.col("c_custkey")
    clients = V.table(s, d, "customer").select("c_custkey", F.when(key % 3 != 0, mac(key % 200)).alias("ap_mac"), mac(key % 7).alias("sw_mac"))
    known = V.table(s, d, "supplier").select(mac(F.col("s_suppkey")).alias("mac"), F.col("s_name").alias("name"))
    return changes.uplinks(clients, known).select("c_custkey", "ap_name", "switch_name")


@query(
    "system_report",
    f""", {registry.HEALTH_SQL},
    beats AS (SELECT CASE WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(max(queried_at))) >= 86400 THEN 'down' ELSE 'ok' END AS status FROM lookups GROUP BY device_id),
    parts AS (SELECT 'sources' AS part, status FROM judged UNION ALL SELECT 'workers', status FROM beats),
    ranked AS (SELECT part, max(CASE status WHEN 'down' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) AS r FROM parts GROUP BY 1),
    failed AS (SELECT count(*) AS n FROM findings WHERE status = 'open' AND occurred_at >= TIMESTAMP '2000-01-01'),
    every AS (SELECT part, r FROM ranked UNION ALL SELECT 'system', greatest(max(r), CASE WHEN (SELECT n FROM failed) > 0 THEN 1 ELSE 0 END) FROM ranked)
    SELECT part, CASE r WHEN 2 THEN 'down' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status FROM every""",
)
def _(s, d):
    beats = V.lookups(s, d).select(F.col("device_id").cast("string").alias("component"), F.col("queried_at").alias("seen_at"))
    workers = changes.heartbeats(beats, NOW, 86400).select(F.lit("workers").alias("part"), "component", "status")
    sources = health.source_health(registry.attempts(s, d), NOW, stale=90000).select(F.lit("sources").alias("part"), F.col("source").alias("component"), "status")
    return health.system_report(workers.unionByName(sources), health.failed_batches(registry.batch_rows(s, d), "2000-01-01 00:00:00"))


@query(
    "streaming_attribution",
    """, alone AS (SELECT id, count(DISTINCT device_id) AS n, min(device_id) AS device_id FROM matches GROUP BY 1)
    SELECT l.id, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'attributed' ELSE 'unattributed' END AS status, CASE WHEN n = 1 THEN a.device_id END AS device_id
    FROM addressed l LEFT JOIN alone a ON a.id = l.id""",
)
def _(s, d):
    """Attribution by address from streams of lookups and claims; claims of the second half come after the lookups of the first."""
    folder = shared_folder(s, "attribution")
    asked = V.addressed(s, d).select("id", "ip", "queried_at")
    claims = V.assignments(s, d).select("ip", "device_id", "observed_from", "observed_to")
    store = attribution.AttributionStore(s, f"{folder}/store")
    stream = lambda frame, name: s.readStream.schema(frame.schema).parquet(f"{folder}/{name}")
    for half in (0, 1):
        asked.filter(f"id % 2 = {half}").write.mode("append").parquet(f"{folder}/lookups")
        claims.filter(f"device_id % 2 = {half}").write.mode("append").parquet(f"{folder}/claims")
        attribution.start(attribution.evidence_stream(stream(asked, "lookups"), stream(claims, "claims"), "40 days", "60 days"), store, f"{folder}/marks", None, None).awaitTermination()
    return store.activity().select("id", "status", "device_id")
