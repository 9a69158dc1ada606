"""Changes of mutable tables as rows to append. A change is a new version; ``feedback.latest_version`` reads the last ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.operators.feedback import latest_version


def patched(rows: DataFrame, patches: DataFrame, key: str, version: Column) -> DataFrame:
    """New versions of ``rows`` for ``patches`` (key and some columns): a field that is NULL in the patch stays as it is.
    Keys without a row are left out; of several patches for a key all must agree."""
    fields = [c for c in patches.columns if c != key]
    given = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = latest_version(rows, [key]).join(given, key)
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else version.cast(rows.schema[c].dataType).alias(c) if c == "version" else F.col(c) for c in rows.columns])


def tombstones(rows: DataFrame, keys: DataFrame, key: str, version: Column, deleted: str = "deleted") -> DataFrame:
    """Versions that mark the rows of ``keys`` as deleted; rows that are gone already get none."""
    live = latest_version(rows, [key], deleted=deleted).join(keys.select(key).distinct(), key, "left_semi")
    return live.select(*[F.lit(True).alias(c) if c == deleted else version.cast(rows.schema[c].dataType).alias(c) if c == "version" else F.col(c) for c in rows.columns])


def resolved_reviews(activity: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, status, device_id, needs_review, manual) for ``decisions`` (id, device_id; NULL leaves it unattributed) on rows
    of the review queue; other rows cannot be resolved and are left out."""
    queued = activity.filter(F.col("needs_review") & F.col("status").isin("ambiguous", "unattributed")).select("id")
    status = F.when(F.col("device_id").isNull(), "unattributed").otherwise("attributed")
    return decisions.select("id", "device_id").join(queued, "id").select("id", status.alias("status"), "device_id", F.lit(False).alias("needs_review"), F.lit(True).alias("manual"))


def heartbeats(beats: DataFrame, now: str, stale: int = 90) -> DataFrame:
    """(component, last_seen, status): a component is down if it has not been seen for ``stale`` seconds."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    return beats.groupBy("component").agg(F.max("seen_at").alias("last_seen")).withColumn("status", F.when(F.coalesce(age, F.lit(stale)) >= stale, "down").otherwise("ok"))


def batch_row(counts: DataFrame, source: str, started: str, error: Column) -> DataFrame:
    """One status row of a batch from (records): failed, with no records, if there is an error."""
    return counts.select(F.lit(source).alias("source"), F.lit(started).cast("timestamp_ntz").alias("started_at"), F.when(error.isNotNull(), "failed").otherwise("succeeded").alias("status"), F.when(error.isNotNull(), F.lit(0)).otherwise(F.col("records")).cast("long").alias("records"), error.alias("error"))


def baseline_history(baselines: DataFrame, window: str, computed_at: str) -> DataFrame:
    """Rows to append to the history of baselines, one for each subject, its metrics as one map."""
    entry = F.struct("metric", F.struct("sample_count", "mean", "stddev", "p95", "high_threshold").alias("v"))
    grouped = baselines.groupBy("device_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics"), F.max("sample_count").alias("sample_count"))
    return grouped.select("device_id", F.lit(window).alias("window"), F.lit(computed_at).cast("timestamp_ntz").alias("computed_at"), "sample_count", "metrics")


def observations(clients: DataFrame) -> DataFrame:
    """Sightings of devices from normalized clients, with a hint of a name: the host name, else the DNS client."""
    name = F.coalesce(F.nullif("hostname", F.lit("")), F.col("dns_client")) if "dns_client" in clients.columns else F.nullif("hostname", F.lit(""))
    return clients.select("mac", "controller_id", "hostname", "ip", F.col("last_seen").alias("observed_at"), name.alias("display_name_hint"))


def baseline_rows(history: DataFrame) -> DataFrame:
    """The statistics of a history of baselines, one row for each subject, time and metric: what ``baseline_history`` packed."""
    return history.select("device_id", "window", "computed_at", F.explode("metrics").alias("metric", "v")).select("device_id", "window", "computed_at", "metric", "v.*")


def uplinks(clients: DataFrame, infrastructure: DataFrame) -> DataFrame:
    """``clients`` with ap_name and switch_name: the infrastructure device (mac, name) whose MAC is the client's ap_mac or sw_mac."""
    known = infrastructure.filter("mac IS NOT NULL").groupBy("mac").agg(F.min("name").alias("name"))
    named = lambda mac, name: known.select(F.col("mac").alias(mac), F.col("name").alias(name))
    return clients.join(named("ap_mac", "ap_name"), "ap_mac", "left").join(named("sw_mac", "switch_name"), "sw_mac", "left")
