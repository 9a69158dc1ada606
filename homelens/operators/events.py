"""Live events: publishing, order by severity, paging and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.functions.normalize import severity_rank

# Ids of the finding rules.
RULES = ("unknown_device_online", "blocked_query_burst", "dns_volume_increase", "activity_outside_expected_hours", "new_domain_burst", "connection_flapping", "controller_security_event")


def finding_events(created: DataFrame) -> DataFrame:
    """An event for each new finding of a known rule; the event's kind is the rule."""
    return created.filter(F.col("created") & F.col("rule_id").isin(*RULES)).select(F.sha2("fingerprint", 256).alias("id"), F.col("rule_id").alias("kind"), "severity", "summary", "device_id", "occurred_at")


def recent_events(events: DataFrame, most: int) -> DataFrame:
    return events.orderBy(severity_rank(F.col("severity")).desc(), F.col("occurred_at").desc(), F.col("id").desc()).limit(most)


def page_after(events: DataFrame, created: str, id_column: str, after: str, after_id: int, most: int = 100) -> DataFrame:
    """The next page of (created, id) past a mark, oldest first."""
    t, i = F.lit(after).cast("timestamp_ntz"), F.lit(after_id)
    return events.filter((F.col(created) > t) | ((F.col(created) == t) & (F.col(id_column) > i))).orderBy(created, id_column).limit(most)


def sse_frame(id_column: Column, kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("id: "), id_column.cast("string"), F.lit("\nevent: "), kind, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))
