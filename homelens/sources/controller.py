"""Controller snapshots and events: envelopes of JSON rows, normalized to sightings and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homelens.functions.normalize import classify_transition, normalize_mac, parse_time, text_or_null
from homelens.sources.dns_log import read_envelopes


def normalize_clients(payloads: DataFrame, now: str) -> DataFrame:
    """One row a client: identifiers, address, times (missing ones are ``now``, swapped if reversed) and counters.

    Bytes sent by the network are the client's download.
    """
    get = lambda k: text_or_null(F.get_json_object("payload", f"$.{k}"))
    at = F.lit(now).cast("timestamp")
    first, last = F.coalesce(parse_time(get("first_seen"), True), at), F.coalesce(parse_time(get("last_seen"), True), at)
    return payloads.select(
        F.coalesce(get("_id"), get("user_id")).alias("controller_id"), normalize_mac(get("mac")).alias("mac"), F.coalesce(get("hostname"), get("name")).alias("hostname"), F.coalesce(get("ip"), get("last_ip")).alias("ip"),
        F.least(first, last).alias("first_seen"), F.greatest(first, last).alias("last_seen"), get("tx_bytes").try_cast("long").alias("download_bytes"), get("rx_bytes").try_cast("long").alias("upload_bytes"), get("uptime").try_cast("double").alias("uptime"),
        F.coalesce(get("essid"), get("ssid")).alias("ssid"), F.coalesce(get("network"), get("network_name")).alias("network"), normalize_mac(get("ap_mac")).alias("ap_mac"), normalize_mac(get("sw_mac")).alias("sw_mac"), get("sw_port").try_cast("int").alias("sw_port"), F.coalesce(get("is_wired").try_cast("boolean"), F.lit(False)).alias("is_wired"),
    )


def normalize_events(payloads: DataFrame, ingested_at: str) -> DataFrame:
    """(id, seen_at, event_name, msg, mac, kind): numeric ``time`` in seconds, else ``datetime``, else the ingest time."""
    get = lambda k: text_or_null(F.get_json_object("payload", f"$.{k}"))
    when = F.coalesce(F.timestamp_seconds(get("time").try_cast("double")), F.try_to_timestamp(get("datetime")), F.lit(ingested_at).cast("timestamp"))
    return payloads.select(get("_id").alias("id"), when.alias("seen_at"), get("key").alias("event_name"), get("msg").alias("msg"), normalize_mac(get("mac")).alias("mac"), classify_transition(get("key"), get("msg")).alias("kind"))


def read_snapshot(spark: SparkSession, folder: str, now: str, clients: str = "clients.json", events: str = "events.json") -> tuple[DataFrame, DataFrame]:
    """Sightings and transitions of a recorded snapshot: two files of envelopes in one folder; a missing file is an error."""
    rows = lambda name: read_envelopes(spark, f"{folder.rstrip('/')}/{name}", ("data",))
    return normalize_clients(rows(clients), now), normalize_events(rows(events), now)
