"""The household relations as views of the driver's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, NOW = "2024-01-24 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    status = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "view", "cached").otherwise("allowed")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("queried_at"), F.col("user_id").alias("device_id"), F.concat(F.lit("d"), k, F.lit(".example")).alias("domain"), status.alias("status"), k.alias("ip"), "event_type", "value")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with the time of their last lookup; one aggregate of the events, joined on the device."""
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("device_id")).agg(F.max("ts").alias("last_seen"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.col("c_name").alias("display_name"), (F.col("c_acctbal") < 0).alias("is_unknown"), F.col("c_nationkey").alias("person_id"))
    return known.join(last, "device_id", "left")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("n_regionkey") == 0, "parent").when(F.col("n_regionkey") == 1, "child").otherwise("other")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("person_id"), F.col("n_name").alias("name"), role.alias("role"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("device_id"), F.col("c_nationkey").alias("person_id"), F.lit(True).alias("active"), F.col("c_custkey").alias("assigned_at"))


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups with an address and a client name: addresses of a device that last some days, a few that guests share, names
    of a device, names that several devices show, and no name. ``seen`` is the address that the controller reports then."""
    k, device = F.col("ip").cast("int"), F.col("device_id").cast("string")
    own = F.concat(F.lit("a"), device, F.lit("."), F.floor(F.day("queried_at") / 10).cast("string"))
    guest = lambda n: F.concat(F.lit("s"), n.cast("string"))
    shown = F.concat(F.lit("x"), (F.col("device_id") % 7).cast("string"))
    client = F.when(k % 4 == 0, F.concat(F.lit(" c"), device)).when(k % 4 == 1, F.concat(F.lit("h"), device, F.lit(" "))).when(k % 4 == 2, shown).otherwise("")
    return lookups(spark, sf_dir).select(
        "id", "queried_at", "device_id", "domain", "status", F.when(k < 15, guest(k)).otherwise(own).alias("ip"), F.when(k < 15, guest(k * 7 % 15)).otherwise(own).alias("seen"),
        client.alias("client"), F.when(k % 4 == 0, "dns_client").otherwise("hostname").alias("kind"),
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from homelens.operators.identity import ip_history

    return ip_history(addressed(spark, sf_dir).select("id", "device_id", F.col("seen").alias("ip"), F.col("queried_at").alias("observed_at")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client names with their owners: the first device that shows one."""
    from homelens.operators.identity import identifier_claims

    shown = addressed(spark, sf_dir).filter("client <> ''").select(F.col("id").alias("seq"), "kind", F.trim("client").alias("value"), "device_id", F.col("queried_at").alias("seen_at"))
    return identifier_claims(shown)


def transitions_of(rows: DataFrame) -> DataFrame:
    """Connections and disconnections among some lookups."""
    kind = F.when(F.col("event_type") == "click", "connect").otherwise("disconnect")
    return rows.filter("event_type IN ('click', 'signup')").select("id", F.col("queried_at").alias("seen_at"), "device_id", F.lit(None).cast("string").alias("mac"), kind.alias("kind"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions_of(lookups(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups(spark, sf_dir).filter("event_type = 'purchase'")
    return rows.select("id", F.col("queried_at").alias("observed_at"), "device_id", F.floor("value").cast("long").alias("upload_bytes"), F.floor(F.col("value") * 10).cast("long").alias("download_bytes"), F.round("value", 1).alias("connection_duration_seconds"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").when(F.col("o_orderpriority").startswith("3"), "low").otherwise("info")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "resolved").otherwise("acknowledged")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), severity.alias("severity"), status.alias("status"), F.col("o_orderdate").alias("occurred_at"), F.col("o_custkey").alias("device_id"))


SQL = f"""
WITH RECURSIVE lookups AS (
    SELECT event_id AS id, ts AS queried_at, user_id AS device_id, 'd' || regexp_extract(props, '[0-9]+') || '.example' AS domain,
        CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'cached' ELSE 'allowed' END AS status, regexp_extract(props, '[0-9]+') AS ip, event_type, value
    FROM events
), devices AS (
    SELECT c_custkey AS device_id, c_name AS display_name, c_acctbal < 0 AS is_unknown, c_nationkey AS person_id, last_seen
    FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1) ON user_id = c_custkey
), people AS (
    SELECT n_nationkey AS person_id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'parent' WHEN 1 THEN 'child' ELSE 'other' END AS role FROM nation
), links AS (
    SELECT c_custkey AS device_id, c_nationkey AS person_id FROM customer WHERE c_custkey % 3 <> 0
), addressed AS (
    SELECT id, queried_at, device_id, domain, status, CASE WHEN k < 15 THEN 's' || k ELSE own END AS ip, CASE WHEN k < 15 THEN 's' || (k * 7 % 15) ELSE own END AS seen,
        CASE k % 4 WHEN 0 THEN 'c' || device_id WHEN 1 THEN 'h' || device_id WHEN 2 THEN 'x' || (device_id % 7) ELSE '' END AS client, CASE k % 4 WHEN 0 THEN 'dns_client' ELSE 'hostname' END AS kind
    FROM (SELECT *, ip::INTEGER AS k, 'a' || device_id || '.' || (day(queried_at) // 10) AS own FROM lookups)
), sightings AS (
    SELECT *, lag(seen) OVER (PARTITION BY device_id ORDER BY queried_at, id) AS before FROM addressed
), assignments AS (
    SELECT device_id, seen AS ip, queried_at AS observed_from, lead(queried_at) OVER (PARTITION BY device_id ORDER BY queried_at, id) AS observed_to
    FROM sightings WHERE before IS NULL OR before <> seen
), transitions AS (
    SELECT id, queried_at AS seen_at, device_id, CASE event_type WHEN 'click' THEN 'connect' ELSE 'disconnect' END AS kind FROM lookups WHERE event_type IN ('click', 'signup')
), snapshots AS (
    SELECT id, queried_at AS observed_at, device_id, floor(value)::BIGINT AS upload_bytes, floor(value * 10)::BIGINT AS download_bytes, round(value, 1) AS connection_duration_seconds FROM lookups WHERE event_type = 'purchase'
), findings AS (
    SELECT o_orderkey AS id, CASE o_orderpriority[1] WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' ELSE 'info' END AS severity,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'acknowledged' END AS status, o_orderdate AS occurred_at, o_custkey AS device_id FROM orders
), first_seen AS (
    SELECT device_id, domain, min(queried_at) AS first_seen FROM lookups WHERE queried_at <= TIMESTAMP '{NOW}' GROUP BY 1, 2
), win AS (
    SELECT * FROM lookups WHERE queried_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{NOW}'
), samples AS (
    SELECT l.device_id, idx, count(*) AS dns_query_volume, count(DISTINCT l.domain) AS unique_domain_count,
        count(DISTINCT CASE WHEN f.first_seen >= TIMESTAMP '{NOW}' - to_days((idx + 1)::INTEGER) THEN l.domain END) AS new_domain_count,
        count(DISTINCT date_trunc('hour', queried_at)) AS active_hour_count,
        round(100.0::DOUBLE * count(*) FILTER (status = 'blocked') / count(*), 4) AS blocked_query_pct, list(DISTINCT hour(queried_at)) AS hours
    FROM lookups l JOIN (SELECT unnest(range(0, 14)) AS idx) g ON queried_at BETWEEN TIMESTAMP '{NOW}' - to_days((idx + 1)::INTEGER) AND TIMESTAMP '{NOW}' - to_days(idx::INTEGER)
    JOIN first_seen f ON f.device_id = l.device_id AND f.domain = l.domain GROUP BY 1, 2
), volume_baseline AS (
    SELECT device_id, count(*) AS sample_count, round(avg(dns_query_volume), 6) AS mean, round(coalesce(stddev_samp(dns_query_volume), 0), 6) AS stddev,
        round(percentile_disc(0.95) WITHIN GROUP (ORDER BY dns_query_volume)::DOUBLE, 6) AS p95, round(avg(dns_query_volume) + 2 * coalesce(stddev_samp(dns_query_volume), 0), 6) AS high_threshold FROM samples GROUP BY 1
), stats AS (
    SELECT w.device_id, count(*) AS dns_query_volume, count(*) FILTER (status = 'blocked') AS blocked_query_count, count(DISTINCT w.domain) AS unique_domain_count,
        count(DISTINCT CASE WHEN first_seen >= TIMESTAMP '{START}' THEN w.domain END) AS new_domain_count, count(DISTINCT date_trunc('hour', queried_at)) AS active_hour_count
    FROM win w JOIN first_seen f ON f.device_id = w.device_id AND f.domain = w.domain GROUP BY 1
), matches AS (
    SELECT l.id, l.ip, a.device_id FROM addressed l JOIN assignments a ON a.ip = l.ip AND a.observed_from <= l.queried_at AND (a.observed_to IS NULL OR a.observed_to > l.queried_at)
)
"""
