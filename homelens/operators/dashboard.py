"""The household summary: counts, attention items, trends, active children and recent lookups.

Sections whose source is down are NULL, not zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")

NAMED = 20


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Open findings of every severity; those without any are 0."""
    listed = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = findings.filter("status = 'open'").groupBy("severity").agg(F.count("*").alias("n"))
    return listed.join(counts, "severity", "left").fillna({"n": 0})


def device_views(devices: DataFrame, links: DataFrame, people: DataFrame, now: str, online: int = 300) -> DataFrame:
    """Devices with person, role, online and unassigned flags."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {online} SECONDS")
    joined = devices.join(links.select("device_id", "person_id"), "device_id", "left").join(people.select("person_id", F.col("name").alias("person_name"), "role"), "person_id", "left")
    return joined.withColumn("online", F.coalesce(F.col("last_seen") >= since, F.lit(False))).withColumn("unassigned", F.col("person_id").isNull())


def filter_devices(views: DataFrame, online: bool | None = None, unknown: bool | None = None, unassigned: bool | None = None) -> DataFrame:
    for column, wanted in (("online", online), ("is_unknown", unknown), ("unassigned", unassigned)):
        if wanted is not None:
            views = views.filter(F.col(column) == wanted)
    return views


def attention_items(sources: DataFrame, reviews: DataFrame, devices: DataFrame, most: int = 5) -> DataFrame:
    """The first items that want attention: sources that are not ok, then the review queue, then unknown or
    unassigned devices online. The limit is the report's."""
    a = sources.filter("status <> 'ok'").select(F.lit(0).alias("tier"), F.col("source").alias("item"), F.concat("source", F.lit(" is "), "status").alias("summary"))
    b = reviews.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(1).alias("tier"), F.lit("review").alias("item"), F.concat("n", F.lit(" lookups to review")).alias("summary"))
    c = devices.filter("online AND (is_unknown OR unassigned)").select(F.lit(2).alias("tier"), F.col("device_id").cast("string").alias("item"), F.concat("display_name", F.lit(" is unknown or has no person")).alias("summary"))
    return a.unionByName(b).unionByName(c).orderBy("tier", "item").limit(most)


def household_status(sources: DataFrame, items: DataFrame, count: DataFrame) -> DataFrame:
    """One row (status, reason) from incomplete sources, the first ``NAMED`` by name, else from what wants attention, else ok."""
    first = sources.filter("status = 'down'").select("source").orderBy("source").limit(NAMED + 1)
    names = F.array_sort(F.collect_list("source"))
    more = F.when(F.size(names) > NAMED, " and more").otherwise("")
    down = first.agg(F.concat(F.array_join(F.slice(names, 1, NAMED), ", "), more).alias("down"))
    top = items.agg(F.min_by("summary", F.struct("tier", "item")).alias("top"))
    one = down.crossJoin(top).crossJoin(count.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))  # one row each
    status = F.when(F.col("down") != "", "incomplete").when(F.col("n") > 0, "attention").otherwise("ok")
    reason = F.when(F.col("down") != "", F.concat(F.lit("no data from "), "down")).when(F.col("n") == 1, F.col("top")).when(F.col("n") > 1, F.concat("n", F.lit(" items need attention, first: "), "top")).otherwise("nothing needs attention")
    return one.select(status.alias("status"), reason.alias("reason"))


def recent_activity(lookups: DataFrame, most: int = 10) -> DataFrame:
    """Blocked lookups first, then those to review, then attributed ones, newest first, each lookup once."""
    tier = F.when(F.col("status") == "blocked", 0).when(F.col("needs_review"), 1).when(F.col("device_id").isNotNull(), 2)
    return lookups.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", F.col("queried_at").desc(), F.col("id").desc()).limit(most)


def trend_delta(today: DataFrame, means: DataFrame) -> DataFrame:
    """(metric, value, mean, delta): delta is NULL if either side is missing."""
    return today.join(means, "metric", "full").select("metric", "value", "mean", F.round(F.col("value") - F.col("mean"), 6).alias("delta"))


def active_children(views: DataFrame, recent: DataFrame) -> DataFrame:
    """(person_id, person_name, devices, last_activity) of children with a device online or with recent lookups (device_id, last_activity)."""
    joined = views.filter("role = 'child'").join(recent, "device_id", "left").filter("online OR last_activity IS NOT NULL")
    return joined.groupBy("person_id", "person_name").agg(F.count("*").alias("devices"), F.max(F.greatest("last_activity", F.when(F.col("online"), F.col("last_seen")))).alias("last_activity"))


def first_person_devices(links: DataFrame) -> DataFrame:
    """The first active link of each device, by time of assignment, then id."""
    rest = [c for c in links.columns if c != "device_id"]
    return links.filter("active").groupBy("device_id").agg(F.min_by(F.struct(*rest), F.struct("assigned_at", "id")).alias("_r")).select("device_id", "_r.*").select(*links.columns)
