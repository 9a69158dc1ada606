"""Explainable finding rules over lookups, transitions, baselines and security lines.

Every rule returns drafts of one shape. Time is a parameter; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homelens.functions.normalize import fingerprint, general_number, window_floor
from homelens.operators import feedback, skew

BURST_COUNT, BURST_SECONDS = 5, 15 * 60
FLAP_COUNT, FLAP_SECONDS = 6, 30 * 60
VOLUME_RATIO, VOLUME_LEAST = 2.0, 20
NEW_COUNT, NEW_RATIO = 8, 3.0
OUTSIDE_LEAST = 3
ONLINE_SECONDS = 300
CHUNK = 16
DRAFT = ["rule_id", "severity", "confidence", "subject_label", "fingerprint", "device_id", "occurred_at", "n", "summary", "domains", "pattern"]
DOMAINS = 20


def _draft(rows: DataFrame, rule: str, severity: Column | str, confidence: Column | str, label: Column, mark: Column, device: Column, at: Column, n: Column, summary: Column, named: bool = False) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        F.lit(rule).alias("rule_id"), as_column(severity).alias("severity"), as_column(confidence).alias("confidence"), label.alias("subject_label"), mark.alias("fingerprint"),
        device.cast("long").alias("device_id"), at.cast("timestamp_ntz").alias("occurred_at"), n.cast("long").alias("n"), summary.alias("summary"),
        F.col("domains") if named else F.lit(None).cast("array<string>").alias("domains"), F.col("pattern") if named else F.lit("*").alias("pattern"),
    )


def named_domains(rows: DataFrame, key: str, most: int = DOMAINS) -> DataFrame:
    """(key, domains, pattern): the first ``most`` domains of each key, by name, and the pattern of all of them."""
    each = rows.filter("domain IS NOT NULL").select(key, "domain").distinct()
    bounds = each.groupBy(key).agg(*feedback.pattern_bounds(F.col("domain"))).select(key, feedback.bounded_pattern().alias("pattern"))
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("domain"))).filter(F.col("_r") <= most)
    return first.groupBy(key).agg(F.array_sort(F.collect_list("domain")).alias("domains")).join(bounds, key)


def burst_spans(events: DataFrame, key: str, ts: str, tie: str, seconds: int, least: int) -> DataFrame:
    """(key, n, first, last) of each key's largest span of ``seconds``, the earliest one of equals.

    A range frame counts every event with the ones before it, then the earliest of the best rows stands for
    the span. Time is cut into chunks of ``CHUNK`` spans, each with the span before it, so that a busy key, such as
    that of all lookups without a device, is many windows.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    chunk = F.floor(F.col("_t") / (CHUNK * span))
    reaches = F.col("_t") >= (chunk + 1) * (CHUNK * span) - span
    dealt = events.withColumn("_t", micros).withColumn("_c", F.explode(F.when(reaches, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    frame = Window.partitionBy(key, "_c").orderBy("_t").rangeBetween(-span, 0)
    counted = dealt.withColumn("n", F.count("*").over(frame)).withColumn("first", F.min(ts).over(frame)).filter(F.col("_c") == chunk)
    best = counted.groupBy(key).agg(F.min_by(F.struct("n", "first", F.col(ts).alias("last")), F.struct(-F.col("n"), "_t", tie)).alias("b"))
    return best.filter(F.col("b.n") >= least).select(key, "b.n", "b.first", "b.last")


def burst_members(events: DataFrame, spans: DataFrame, key: str, ts: str, tie: str = "id") -> DataFrame:
    """The events of each key's span; keys with a great many events are dealt over several tasks."""
    return skew.dealt_join(events, spans.select(key, "first", "last"), [key], tie).filter(F.col(ts).between(F.col("first"), F.col("last"))).drop("first", "last")


def rule_unknown_device(devices: DataFrame, now: str, online: int = ONLINE_SECONDS) -> DataFrame:
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {online} SECONDS")
    seen = devices.filter(F.col("is_unknown") & (F.col("last_seen") >= since))
    label = F.coalesce("display_name", F.concat(F.lit("device "), F.col("device_id")))
    mark = fingerprint(F.lit("unknown_device_online"), F.col("device_id"), window_floor(F.lit(now).cast("timestamp"), 3600))
    return _draft(seen, "unknown_device_online", "medium", "high", label, mark, F.col("device_id"), F.col("last_seen"), F.lit(1), F.concat(label, F.lit(" has no strong identifier and is online")))


def rule_blocked_burst(lookups: DataFrame, seconds: int = BURST_SECONDS, least: int = BURST_COUNT) -> DataFrame:
    """Many blocked lookups of one device, or of those without a device, within ``seconds``."""
    blocked = lookups.filter("status = 'blocked'").withColumn("subject", F.coalesce(F.col("device_id").cast("string"), F.lit("unattributed")))
    spans = burst_spans(blocked, "subject", "queried_at", "id", seconds, least)
    spans = spans.join(named_domains(burst_members(blocked, spans, "subject", "queried_at"), "subject"), "subject", "left")
    mark = fingerprint(F.lit("blocked_query_burst"), F.col("subject"), window_floor(F.col("first").cast("timestamp"), BURST_SECONDS))
    label = F.when(F.col("subject") == "unattributed", F.col("subject")).otherwise(F.concat(F.lit("device "), F.col("subject")))
    return _draft(spans, "blocked_query_burst", "medium", "high", label, mark, F.col("subject").try_cast("long"), F.col("last"), F.col("n"), F.concat(F.col("n"), F.lit(" blocked DNS lookups for "), label), named=True)


def rule_flapping(transitions: DataFrame, seconds: int = FLAP_SECONDS, least: int = FLAP_COUNT) -> DataFrame:
    """Many changes between connected and disconnected of a device (else MAC); the best span must hold both."""
    keyed = transitions.withColumn("subject", F.coalesce(F.col("device_id").cast("string"), F.col("mac"), F.lit("unknown")))
    spans = burst_spans(keyed, "subject", "seen_at", "id", seconds, least)
    kinds = burst_members(keyed, spans, "subject", "seen_at").groupBy("subject").agg(F.count_distinct("kind").alias("kinds"))
    both = spans.join(kinds.filter("kinds > 1"), "subject")
    mark = fingerprint(F.lit("connection_flapping"), F.col("subject"), window_floor(F.col("first").cast("timestamp"), FLAP_SECONDS))
    return _draft(both, "connection_flapping", "low", "high", F.col("subject"), mark, F.col("subject").try_cast("long"), F.col("last"), F.col("n"), F.concat(F.col("n"), F.lit(" connection changes for "), F.col("subject")))


def rule_volume(stats: DataFrame, baselines: DataFrame, start: str, end: str, least: int = VOLUME_LEAST, deviating: DataFrame | None = None) -> DataFrame:
    """Lookup volume far above the subject's mean. ``baselines``: metric_baseline rows of dns_query_volume."""
    joined = stats.filter(F.col("dns_query_volume") >= least).join(baselines.filter("sample_count >= 1"), "device_id")
    ratio = F.when(F.col("mean") <= 0, F.lit(float("inf"))).otherwise(F.col("dns_query_volume") / F.nullif(F.col("mean"), F.lit(0.0)))
    rated = joined.withColumn("ratio", ratio)
    if deviating is None:
        rated = rated.withColumn("deviates", F.lit(False))
    else:
        rated = rated.join(deviating.select("device_id", F.lit(True).alias("deviates")).distinct(), "device_id", "left")
    hit = rated.filter((F.col("ratio") >= VOLUME_RATIO) | F.coalesce("deviates", F.lit(False)))
    mark = fingerprint(F.lit("dns_volume_increase"), F.col("device_id"), F.lit(start), F.lit(end))
    label = F.concat(F.lit("device "), F.col("device_id"))
    text = F.concat(F.col("dns_query_volume"), F.lit(" DNS lookups for "), label, F.lit(" against a mean of "), general_number(F.col("mean")))
    return _draft(hit, "dns_volume_increase", F.when(F.col("ratio") < 4, "low").otherwise("medium"), F.when(F.col("sample_count") >= 3, "medium").otherwise("low"), label, mark, F.col("device_id"), F.lit(end), F.col("dns_query_volume"), text)


def rule_outside_hours(lookups: DataFrame, hours: DataFrame, start: str, least: int = OUTSIDE_LEAST) -> DataFrame:
    """Lookups outside the expected hours of subjects that have any. ``hours``: (device_id, hour)."""
    expected = hours.filter("hour BETWEEN 0 AND 23")
    known = lookups.join(expected.select("device_id").distinct(), "device_id", "left_semi").withColumn("hour", F.hour("queried_at"))
    outside = known.join(expected, ["device_id", "hour"], "left_anti").groupBy("device_id").agg(F.count("*").alias("n"), F.max("queried_at").alias("last"), F.array_sort(F.collect_set("hour")).alias("hours")).filter(F.col("n") >= least)
    mark = fingerprint(F.lit("activity_outside_expected_hours"), F.col("device_id"), F.lit(start))
    label = F.concat(F.lit("device "), F.col("device_id"))
    text = F.concat(F.col("n"), F.lit(" DNS lookups outside expected hours, in UTC hours "), F.array_join("hours", ", "))
    return _draft(outside, "activity_outside_expected_hours", "low", "medium", label, mark, F.col("device_id"), F.col("last"), F.col("n"), text)


def rule_new_domains(stats: DataFrame, baselines: DataFrame, start: str, end: str, least: int = NEW_COUNT, fresh: DataFrame | None = None) -> DataFrame:
    """Many new domains, unless the subject's mean is positive and not exceeded three times. ``fresh``: (device_id, domain) of the new ones."""
    joined = stats.filter(F.col("new_domain_count") >= least).join(baselines.filter("sample_count >= 1").select("device_id", "mean"), "device_id", "left")
    hit = joined.filter(F.col("mean").isNull() | (F.col("mean") <= 0) | (F.col("new_domain_count") >= NEW_RATIO * F.col("mean")))
    if fresh is not None:
        hit = hit.join(named_domains(fresh.join(hit.select("device_id"), "device_id", "left_semi"), "device_id", 30), "device_id", "left")
    mark = fingerprint(F.lit("new_domain_burst"), F.col("device_id"), F.lit(start))
    label = F.concat(F.lit("device "), F.col("device_id"))
    return _draft(hit, "new_domain_burst", "low", "medium", label, mark, F.col("device_id"), F.lit(end), F.col("new_domain_count"), F.concat(F.col("new_domain_count"), F.lit(" new domains in DNS lookups for "), label), named=fresh is not None)


def rule_security(lines: DataFrame) -> DataFrame:
    """Every parsed line of category security. ``lines``: (id, seen_at, event_name, category, mac, device_id)."""
    hit = lines.filter(F.lower("category") == "security")
    mark = fingerprint(F.lit("controller_security_event"), F.coalesce(F.col("id").cast("string"), F.concat_ws(":", F.col("seen_at").cast("string"), "event_name", "mac")))
    label = F.coalesce(F.concat(F.lit("device "), F.col("device_id")), F.col("mac"), F.lit("network"))
    return _draft(hit, "controller_security_event", "high", "high", label, mark, F.col("device_id"), F.col("seen_at"), F.lit(1), F.concat(F.lit("security event "), F.col("event_name")))


def all_drafts(*drafts: DataFrame) -> DataFrame:
    """The drafts of all rules as one table."""
    first, *rest = drafts
    for d in rest:
        first = first.unionByName(d)
    return first


def evaluate(*drafts: DataFrame) -> DataFrame:
    """All drafts by (occurred_at, rule_id, fingerprint), for readers who want them in this order."""
    return all_drafts(*drafts).orderBy("occurred_at", "rule_id", "fingerprint")


def expected_hours(schedules: DataFrame, typical: DataFrame, links: DataFrame, weekday: int) -> DataFrame:
    """(device_id, hour, source): the active schedule of the device's person, else of the device, else typical hours.

    Of several schedules for a subject the one updated first holds; hours are clipped to 0..23.
    """
    today = schedules.filter(F.col("active") & (F.col("days_of_week").isNull() | F.array_contains("days_of_week", weekday)))
    valid = today.withColumn("hours", F.filter("expected_hours_utc", lambda h: h.between(0, 23))).filter(F.size("hours") > 0)
    pick = lambda key: valid.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("hours", "updated_at").alias("hours"))
    of_person = links.join(pick("person_id"), "person_id").select("device_id", F.col("hours").alias("person_hours"))
    of_device = pick("device_id").select("device_id", F.col("hours").alias("device_hours"))
    usual = typical.groupBy("device_id").agg(F.collect_set("hour").alias("usual"))
    every = usual.join(of_device, "device_id", "full").join(of_person, "device_id", "full")
    source = F.when(F.col("person_hours").isNotNull() | F.col("device_hours").isNotNull(), "schedule").otherwise("baseline")
    return every.select("device_id", F.explode(F.coalesce("person_hours", "device_hours", "usual")).alias("hour"), source.alias("source"))
