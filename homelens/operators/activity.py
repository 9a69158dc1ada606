"""Activity of subjects in time windows. Windows are closed at both ends; history lies strictly before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.functions.normalize import normalize_domain, percent

# Names of the metrics.
SUMMARY_METRICS = (
    "dns_query_volume", "blocked_query_pct", "unique_domain_count", "new_domain_count", "active_hour_count",
    "upload_bytes", "download_bytes", "connection_duration_seconds",
)


def in_window(ts: Column, start: str, end: str) -> Column:
    return ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def attributed_lookups(activity: DataFrame, queries: DataFrame) -> DataFrame:
    """Lookups whose device is known: activity rows joined to their query."""
    chosen = activity.filter("status = 'attributed'").select(F.col("dns_query_id").alias("id"), "device_id", "confidence")
    return queries.join(chosen, "id")


def prior_domains(lookups: DataFrame, start: str, subject: str = "device_id") -> DataFrame:
    """(subject, domain) seen before the window."""
    before = lookups.filter(F.col("queried_at") < F.lit(start).cast("timestamp_ntz"))
    return before.select(subject, normalize_domain(F.col("domain")).alias("domain")).distinct()


def new_domains(lookups: DataFrame, start: str, end: str, subject: str = "device_id") -> DataFrame:
    """(subject, domain) whose first lookup of all lies in the window: one aggregate in place of an anti join."""
    first = lookups.filter(F.col("queried_at") <= F.lit(end).cast("timestamp_ntz")).groupBy(subject, normalize_domain(F.col("domain")).alias("domain")).agg(F.min("queried_at").alias("first_seen"))
    return first.filter(F.col("first_seen") >= F.lit(start).cast("timestamp_ntz")).select(subject, "domain")


def dns_window_summary(lookups: DataFrame, start: str, end: str, subject: str = "device_id") -> DataFrame:
    """Volume, blocked share, unique and new domains, active hours of each subject.

    Lookups are first grouped by domain, which also yields each domain's first sighting, and by hour, then by
    subject: both groupings shrink before the shuffle, so no subject's rows meet in one task.
    """
    inside = in_window(F.col("queried_at"), start, end)
    upto = lookups.filter(F.col("queried_at") <= F.lit(end).cast("timestamp_ntz"))
    by_domain = upto.groupBy(subject, normalize_domain(F.col("domain")).alias("domain")).agg(F.count_if(inside).alias("n"), F.count_if(inside & (F.col("status") == "blocked")).alias("blocked"), F.min("queried_at").alias("first_seen"))
    summed = by_domain.filter("n > 0").groupBy(subject).agg(
        F.sum("n").alias("dns_query_volume"),
        F.sum("blocked").alias("blocked_query_count"),
        F.count("*").alias("unique_domain_count"),
        F.count_if(F.col("first_seen") >= F.lit(start).cast("timestamp_ntz")).alias("new_domain_count"),
    )
    by_hour = upto.filter(inside).select(subject, F.date_trunc("hour", "queried_at").alias("hour")).distinct()
    hours = by_hour.groupBy(F.col(subject).alias("_subject")).agg(F.count("*").alias("active_hour_count"), F.array_sort(F.collect_set(F.hour("hour"))).alias("active_hours_utc"))
    joined = summed.join(hours, F.col(subject).eqNullSafe(F.col("_subject")))
    return joined.select(
        subject, "dns_query_volume", "blocked_query_count", percent(F.col("blocked_query_count"), F.col("dns_query_volume")).alias("blocked_query_pct"), "unique_domain_count", "new_domain_count",
        "active_hour_count", "active_hours_utc",
    )


def latest_per_key(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last row of each key; ties go to the larger ``tie``. A partial aggregate, so hot keys stay cheap."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(ts, tie)).alias("r"))
    return last.select(key, "r.*")


def traffic_latest_sum(snapshots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals over each device's last snapshot; a total is NULL only if no snapshot has the number."""
    last = latest_per_key(snapshots, "device_id", "observed_at", "id")
    return last.groupBy(*(by or [])).agg(F.sum("upload_bytes").alias("upload_bytes"), F.sum("download_bytes").alias("download_bytes"), F.round(F.sum("connection_duration_seconds"), 3).alias("connection_duration_seconds"), F.count("*").alias("traffic_device_count"))


def activity_summary(dns: DataFrame, traffic: DataFrame, subject: str = "device_id") -> DataFrame:
    """DNS and traffic side by side; subjects without lookups count zero."""
    zero = {"dns_query_volume": 0, "blocked_query_count": 0, "blocked_query_pct": 0.0, "unique_domain_count": 0, "new_domain_count": 0, "active_hour_count": 0}
    return dns.join(traffic, subject, "full").fillna(zero)


def metric_unpivot(summary: DataFrame, subject: str = "device_id") -> DataFrame:
    """(subject, metric, value) for the metrics a summary has; traffic metrics may be absent."""
    have = [m for m in SUMMARY_METRICS if m in summary.columns]
    typed = summary.select(subject, *[F.col(m).cast("double").alias(m) for m in have])
    return typed.unpivot(subject, have, "metric", "value").filter("value IS NOT NULL")


def active_person(links: DataFrame) -> DataFrame:
    """The first active person of each device, by time of assignment, then id."""
    first = links.filter("active").groupBy("device_id").agg(F.min_by("person_id", F.struct("assigned_at", "id")).alias("person_id"))
    return first
