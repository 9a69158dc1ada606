"""Health of sources, batches, worker and system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCES = ("dns_log", "controller_api", "controller_syslog")
STALE_SECONDS, MAX_FAILURES, WORKER_STALE = 300, 3, 90
PARTS = 16


def status_of(last_success: Column, failures: Column, now: Column, stale: int = STALE_SECONDS, most: int = MAX_FAILURES) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(last_success)
    return F.when(last_success.isNull() | (failures >= most), "down").when((age >= stale) | (failures > 0), "degraded").otherwise("ok")


def staleness_seconds(last_success: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(last_success))


def source_health(attempts: DataFrame, now: str, stale: int = STALE_SECONDS, most: int = MAX_FAILURES) -> DataFrame:
    """(source, last_success_at, last_attempt_at, consecutive_failures, status, stale_seconds) folded from attempts
    (source, tried_at, ok): failures count since the last success."""
    last = attempts.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("tried_at"))).alias("last_success_at"), F.max("tried_at").alias("last_attempt_at"))
    part = F.array(*map(F.lit, range(PARTS)))  # a source's attempts meet its last success in parts, so a hot source is no single task
    dealt = attempts.select(F.col("source").alias("_s"), "tried_at", "ok", F.pmod(F.xxhash64("tried_at"), F.lit(PARTS)).cast("int").alias("_p"))
    met = dealt.join(last.withColumn("_part", F.explode(part)), F.col("_s").eqNullSafe(F.col("source")) & (F.col("_p") == F.col("_part")))
    failed = ~F.col("ok") & (F.col("last_success_at").isNull() | (F.col("tried_at") > F.col("last_success_at")))
    counted = met.groupBy("source", "_part", "last_success_at", "last_attempt_at").agg(F.count_if(failed).alias("n"))
    out = counted.groupBy("source").agg(F.max("last_success_at").alias("last_success_at"), F.max("last_attempt_at").alias("last_attempt_at"), F.sum("n").alias("consecutive_failures"))
    at = F.lit(now).cast("timestamp")
    return out.select("source", "last_success_at", "last_attempt_at", "consecutive_failures", status_of(F.col("last_success_at").cast("timestamp"), F.col("consecutive_failures"), at, stale, most).alias("status"), staleness_seconds(F.col("last_success_at").cast("timestamp"), at).alias("stale_seconds"))


def all_sources(health: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """Every source once; those never tried are down."""
    listed = health.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return listed.join(health, "source", "left").fillna({"status": "down", "consecutive_failures": 0})


def last_batches(batches: DataFrame, key: str = "source", ts: str = "started_at", tie: str = "id") -> DataFrame:
    return batches.groupBy(key).agg(F.max_by(F.struct(*[c for c in batches.columns if c != key]), F.struct(ts, tie)).alias("b")).select(key, "b.*")


def failed_batches(batches: DataFrame, since: str) -> DataFrame:
    return batches.groupBy("source").agg(F.count_if((F.col("status") == "failed") & (F.col("started_at") >= F.lit(since).cast("timestamp_ntz"))).alias("failed"))


def rank(status: Column) -> Column:
    return F.when(status == "down", 2).when(status == "degraded", 1).otherwise(0)


def system_status(components: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: the worst component (component, status); otherwise ok, a failed batch degrades it."""
    worst = components.agg(F.max(rank(F.col("status"))).alias("r"))
    count = failed.agg(F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_batches"))
    value = F.when(F.col("r") == 2, "down").when((F.col("r") == 1) | (F.col("failed_batches") > 0), "degraded").otherwise("ok")
    return worst.crossJoin(count).select(value.alias("status"), "failed_batches")  # one row each


def system_report(parts: DataFrame, failed: DataFrame) -> DataFrame:
    """(part, status) of every part (part, component, status) of the system, each the worst of its components, and ``system``, the
    worst of all, degraded by a failed batch."""
    each = parts.groupBy("part").agg(F.max(rank(F.col("status"))).alias("r"))
    named = F.when(F.col("r") == 2, "down").when(F.col("r") == 1, "degraded").otherwise("ok")
    whole = system_status(parts.select("component", "status"), failed).select(F.lit("system").alias("part"), "status")
    return each.select("part", named.alias("status")).unionByName(whole)


def status_changes(history: DataFrame, seconds: int = 7 * 86400, at: str = "checked_at", tie: str | None = None) -> DataFrame:
    """Rows of (source, checked_at, status, ...) where a source goes down: the events of a lost source.

    Each source's history is cut into chunks of ``seconds``; a chunk's first row is compared with the last row before the chunk, so that a
    source's whole history is no single task.
    """
    order = ["_t", tie] if tie else ["_t"]
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    placed = history.withColumn("_t", micros).withColumn("_c", F.floor(F.col("_t") / (seconds * 1_000_000)))
    last = placed.groupBy("source", "_c").agg(F.max_by("status", F.struct(*order)).alias("_last"))
    by_chunk = Window.partitionBy("source").orderBy("_c")  # one row a chunk
    ahead = last.select("source", "_c", F.lag("_last").over(by_chunk).alias("_ahead"))
    inside = F.lag("status").over(Window.partitionBy("source", "_c").orderBy(*order))
    judged = placed.withColumn("_b", inside).join(ahead, ["source", "_c"]).withColumn("_before", F.coalesce("_b", "_ahead"))
    return judged.filter("status = 'down' AND _before IN ('ok', 'degraded')").select(*history.columns)
