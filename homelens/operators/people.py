"""People and their devices over time, schedules and settings: set-wise merges of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homelens.operators import correlate, skew

ASSIGN, UNASSIGN = "assign", "unassign"


def intervals(edits: DataFrame) -> DataFrame:
    """(device_id, person_id, valid_from, valid_to) of ``edits`` (device_id, person_id, action, at, seq), half-open, the last one open.

    An edit gives a device to a person and so takes it from another; giving it to the same one again changes nothing.
    Taking it from a person who does not hold it is refused. Edits count by (at, seq), in whatever order they come.
    """
    order = Window.partitionBy("device_id").orderBy("at", "seq")
    given = F.last(F.when(F.col("action") == ASSIGN, F.col("person_id")), ignorenulls=True).over(order)
    state = F.when(F.col("action") == ASSIGN, F.struct("person_id")).when(F.col("person_id") == given, F.struct(F.lit(None).cast("long").alias("person_id")))
    held = edits.withColumn("_s", state).filter("_s IS NOT NULL").withColumn("_p", F.col("_s.person_id"))
    changed = held.withColumn("_before", F.lag("_s").over(order)).filter(~F.col("_s").eqNullSafe(F.col("_before")))
    spans = changed.select("device_id", F.col("_p").alias("person_id"), F.col("at").alias("valid_from"), F.lead("at").over(order).alias("valid_to"))
    return spans.filter("person_id IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)")


def merged_intervals(stored: DataFrame, log: DataFrame, edits: DataFrame) -> DataFrame:
    """``stored`` after new edits: only the devices that they name are worked out anew, from the log and the edits; all others stay."""
    named = edits.select("device_id").distinct()
    again = log.join(named, "device_id", "left_semi").unionByName(edits)
    return stored.join(named, "device_id", "left_anti").unionByName(intervals(again).select(*stored.columns))


def held_at(rows: DataFrame, spans: DataFrame, width: int = 86400, hot: int = skew.HOT) -> DataFrame:
    """(id, person_id) of the person who held each row's device when it happened; ``rows``: (id, device_id, queried_at)."""
    asked = rows.select("id", F.col("device_id").cast("string").alias("ip"), "queried_at")
    kept = spans.select(F.col("device_id").cast("string").alias("ip"), F.col("person_id").alias("device_id"), F.col("valid_from").alias("observed_from"), F.col("valid_to").alias("observed_to"))
    return correlate.interval_join(asked, kept, width, hot).select("id", F.col("device_id").alias("person_id"))


def with_devices(people: DataFrame, spans: DataFrame, devices: DataFrame) -> DataFrame:
    """``people`` with ``devices``, an array of (display_name, device_id) of the devices that each holds now, by name ('' where there
    is none), then id."""
    open_now = spans.filter("valid_to IS NULL").select("device_id", "person_id").join(devices.select("device_id", "display_name"), "device_id")
    each = open_now.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("display_name", F.lit("")).alias("display_name"), "device_id"))).alias("devices"))
    none = F.array().cast("array<struct<display_name:string,device_id:bigint>>")
    return people.join(each, "person_id", "left").withColumn("devices", F.coalesce("devices", none))


def schedule_faults(hours: Column, days: Column, device: Column, person: Column) -> Column:
    """What is wrong with a schedule: not exactly one subject, no hours, hours outside 0..23, weekdays outside 0..6."""
    wrong = lambda xs, most: F.exists(xs, lambda x: x.isNull() | ~x.between(0, most))
    found = F.array(
        F.when(device.isNull() == person.isNull(), "one of device and person"),
        F.when(F.coalesce(F.size(hours), F.lit(0)) < 1, "no hours"),
        F.when(wrong(hours, 23), "hours of 0 to 23"),
        F.when(days.isNotNull() & ((F.size(days) < 1) | wrong(days, 6)), "weekdays of 0 to 6"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def checked_schedules(schedules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schedules without faults, the others with ``faults``)."""
    judged = schedules.withColumn("faults", schedule_faults(F.col("expected_hours_utc"), F.col("days_of_week"), F.col("device_id"), F.col("person_id")))
    return judged.filter("size(faults) = 0").drop("faults"), judged.filter("size(faults) > 0")


def merged_settings(defaults: DataFrame, patches: DataFrame) -> DataFrame:
    """(key, value, changed): the last patch (key, value, version) of each known key that is not NULL, else its default.

    The one row of thresholds is all its keys, so two patches of different keys both count; unknown keys are left out.
    """
    last = patches.filter("value IS NOT NULL").groupBy("key").agg(F.max_by("value", "version").alias("_v"))
    return defaults.join(last, "key", "left").select("key", F.coalesce("_v", "value").alias("value"), F.col("_v").isNotNull().alias("changed"))
