"""Statistical baselines over trailing windows, and deviations from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homelens.functions.normalize import normalize_domain, percent

Z_CUT, PERCENTILE, SAMPLES, HOUR_SHARE = 2.0, 0.95, 14, 0.5


def window_samples(lookups: DataFrame, end: str, seconds: int = 86400, samples: int = SAMPLES, subject: str = "device_id") -> DataFrame:
    """One row for each subject and trailing window with lookups: (subject, idx, metrics).

    Window i ends i windows before ``end``. Windows are closed at both ends, so a lookup on a border counts
    in both. A domain is new in the window that holds its first lookup ever.
    """
    end_at, step = F.unix_micros(F.lit(end).cast("timestamp")), seconds * 1_000_000
    aged = lookups.withColumn("domain", normalize_domain(F.col("domain"))).withColumn("age", end_at - F.unix_micros(F.col("queried_at").cast("timestamp"))).filter("age >= 0")
    at = F.floor(F.col("age") / step).cast("int")
    both = F.when((F.col("age") % step == 0) & (F.col("age") > 0), F.array(at, at - 1)).otherwise(F.array(at))
    # by hour and by domain first: both groupings shrink before the shuffle
    hourly = aged.withColumn("idx", F.explode(both)).filter(F.col("idx") < samples).groupBy(subject, "idx", F.date_trunc("hour", "queried_at").alias("hour"))
    hourly = hourly.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    seen = aged.groupBy(subject, "domain").agg(F.min("queried_at").alias("first_seen"), F.array_distinct(F.flatten(F.collect_set(both))).alias("idxs"))
    start = F.timestamp_micros(end_at - (F.col("idx") + 1) * F.lit(step)).cast("timestamp_ntz")
    named = seen.withColumn("idx", F.explode("idxs")).filter(F.col("idx") < samples).groupBy(subject, "idx")
    named = named.agg(F.count("domain").alias("domains"), F.count_if(F.col("domain").isNotNull() & (F.col("first_seen") >= start)).alias("new_domains"))
    none = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    parts = hourly.select(subject, "idx", "hour", "n", "blocked", *none("domains", "new_domains")).unionByName(named.select(subject, "idx", F.lit(None).cast("timestamp_ntz").alias("hour"), *none("n", "blocked"), "domains", "new_domains"))
    volume, blocked = F.sum("n"), F.sum("blocked")
    return parts.groupBy(subject, "idx").agg(
        volume.alias("dns_query_volume"),
        percent(blocked, volume).alias("blocked_query_pct"),
        F.sum("domains").alias("unique_domain_count"),
        F.sum("new_domains").alias("new_domain_count"),
        F.count("hour").alias("active_hour_count"),
        F.array_sort(F.collect_set(F.hour("hour"))).alias("hours"),
    )


def window_grid(lookups: DataFrame, end: str, seconds: int = 86400, samples: int = SAMPLES) -> DataFrame:
    """(idx, start, stop, lookups): the trailing windows that end at ``end``, in epoch seconds, and what falls into each."""
    stop = F.unix_timestamp(F.lit(end).cast("timestamp"))
    grid = lookups.sparkSession.range(samples).select(F.col("id").alias("idx"), (stop - (F.col("id") + 1) * seconds).alias("start"), (stop - F.col("id") * seconds).alias("stop"))
    age = stop * 1_000_000 - F.unix_micros(F.col("queried_at").cast("timestamp"))
    step = seconds * 1_000_000
    at = F.floor(age / step)
    both = F.when((age % step == 0) & (age > 0), F.array(at, at - 1)).otherwise(F.array(at))
    counts = lookups.filter(age >= 0).select(F.explode(both).alias("idx")).filter(F.col("idx") < samples).groupBy("idx").agg(F.count("*").alias("n"))
    return grid.join(counts, "idx", "left").select("idx", "start", "stop", F.coalesce("n", F.lit(0)).alias("lookups"))


def metric_baseline(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, standard deviation (0 for one sample), 95th percentile by nearest rank, and mean + 2 sd, to 6 places."""
    x = F.col(value)
    stats = samples.groupBy(*keys).agg(F.count(x).alias("sample_count"), F.avg(x).alias("m"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("s"), F.expr(f"percentile_disc({PERCENTILE}) WITHIN GROUP (ORDER BY {value})").alias("p"))
    return stats.select(*keys, "sample_count", F.round("m", 6).alias("mean"), F.round("s", 6).alias("stddev"), F.round("p", 6).alias("p95"), F.round(F.col("m") + Z_CUT * F.col("s"), 6).alias("high_threshold"))


def typical_hours(samples: DataFrame, subject: str = "device_id") -> DataFrame:
    """(subject, hour) for hours active in at least half of the subject's samples."""
    n = samples.groupBy(subject).agg(F.count("*").alias("n"))
    per_hour = samples.select(subject, F.explode(F.array_distinct("hours")).alias("hour")).groupBy(subject, "hour").agg(F.count("*").alias("k"))
    return per_hour.join(n, subject).filter(F.col("k") >= HOUR_SHARE * F.col("n")).select(subject, "hour")


def dow_pattern(samples: DataFrame, end: str, seconds: int = 86400, subject: str = "device_id") -> DataFrame:
    """(subject, weekday, sample_count, mean_volume) by the weekday (Monday 0) of each window's end, all seven for every
    subject; the mean of none is NULL."""
    stop = F.timestamp_seconds(F.unix_timestamp(F.lit(end).cast("timestamp")) - F.col("idx") * seconds)
    means = samples.groupBy(subject, F.weekday(stop).alias("weekday")).agg(F.count("*").alias("sample_count"), F.round(F.avg("dns_query_volume"), 6).alias("mean_volume"))
    days = samples.select(subject).distinct().withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return days.join(means, [subject, "weekday"], "left").fillna({"sample_count": 0})


def non_empty(samples: DataFrame, subject: str = "device_id") -> DataFrame:
    """Samples with lookups or traffic; of a subject that has none of these the newest one (idx 0 is the newest)."""
    traffic = [F.col(c).isNotNull() for c in ("upload_bytes", "download_bytes") if c in samples.columns]
    full = F.col("dns_query_volume") > 0
    for has in traffic:
        full = full | has
    held = samples.groupBy(subject).agg(F.bool_or(full).alias("_any"), F.min("idx").alias("_newest"))
    return samples.join(held, subject).filter(full | (~F.col("_any") & (F.col("idx") == F.col("_newest")))).drop("_any", "_newest")


def traffic_samples(snapshots: DataFrame, end: str, seconds: int = 86400, samples: int = SAMPLES) -> DataFrame:
    """(device_id, idx, traffic metrics) of each trailing window, from the last snapshot of the device in it."""
    step = seconds * 1_000_000
    age = F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))
    at = F.floor(F.col("age") / step).cast("int")
    both = F.when((F.col("age") % step == 0) & (F.col("age") > 0), F.array(at, at - 1)).otherwise(F.array(at))
    placed = snapshots.withColumn("age", age).filter("age >= 0").withColumn("idx", F.explode(both)).filter(F.col("idx") < samples)
    last = placed.groupBy("device_id", "idx").agg(F.max_by(F.struct("upload_bytes", "download_bytes", "connection_duration_seconds"), F.struct("observed_at", "id")).alias("r"))
    return last.select("device_id", "idx", "r.*")


def deviations(values: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Upward deviations of (keys, value, ...) from their baseline: z score first, then a constant baseline, then p95. Other columns stay.

    The z score is compared as it is and shown to 4 places; ``threshold`` is what the value exceeds.
    """
    z = (F.col("value") - F.col("mean")) / F.nullif(F.col("stddev"), F.lit(0.0))
    kind = F.when((F.col("stddev") > 0) & (z > Z_CUT), "z_score").when((F.col("stddev") == 0) & (F.col("value") > F.col("mean")), "above_constant_mean").when(F.col("value") > F.col("p95"), "percentile")
    joined = values.join(baselines.filter("sample_count >= 1"), keys).withColumn("kind", kind).filter("kind IS NOT NULL")
    threshold = F.when(F.col("kind") == "z_score", F.col("high_threshold")).when(F.col("kind") == "percentile", F.col("p95")).otherwise(F.col("mean"))
    return joined.select(*keys, *[c for c in values.columns if c not in (*keys, "value")], "value", "mean", "stddev", "p95", F.round(z, 4).alias("z_score"), F.round(F.col("value") - F.col("mean"), 6).alias("delta"), threshold.alias("threshold"), "kind")


def latest_baseline(rows: DataFrame, keys: list[str], computed: str = "computed_at", tie: str = "id") -> DataFrame:
    """The newest row of each key, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(computed, tie)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
