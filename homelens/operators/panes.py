"""History that each run extends instead of reading it all again: first sightings by bucket, and panes of activity.

``FirstSeen`` keeps one row for each subject and domain in a table bucketed by both, so a window is compared with all of history by
a join that moves only the window. ``Panes`` keeps what a day adds to any window that is made of whole days: counts by domain and by
hour. A lookup at the very start of a pane is kept apart (``edge``), since windows are closed at both ends and it also counts in the
window before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homelens.functions.normalize import normalize_domain, percent
from homelens.sources import ledger


class FirstSeen:
    """A catalog table (device_id, domain, first_seen) at ``path``, in ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64, subject_type: str = "bigint"):
        self.spark, self.name = spark, name
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (device_id {subject_type}, domain string, first_seen timestamp_ntz) USING parquet "
            f"CLUSTERED BY (device_id, domain) SORTED BY (device_id, domain) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )

    def unseen(self, lookups: DataFrame) -> DataFrame:
        """(device_id, domain, first_seen) of the lookups' domains that history does not have. History is not shuffled."""
        named = lookups.groupBy("device_id", normalize_domain(F.col("domain")).alias("domain")).agg(F.min("queried_at").alias("first_seen"))
        known = self.spark.table(self.name).select(F.col("device_id").alias("_d"), F.col("domain").alias("_n"))
        return named.join(known.hint("merge"), (F.col("device_id") == F.col("_d")) & (F.col("domain") == F.col("_n")), "left_anti")

    def extend(self, lookups: DataFrame) -> DataFrame:
        """Add the lookups' new domains and return them. Lookups come window by window; those of a window that comes twice are not new."""
        fresh = self.unseen(lookups.filter("device_id IS NOT NULL AND domain IS NOT NULL")).checkpoint()
        fresh.select("device_id", "domain", "first_seen").write.insertInto(self.name)
        return fresh


PANE = "kind string, device_id long, pane long, edge boolean, domain string, hour timestamp_ntz, n long, blocked long, first_at timestamp_ntz"


def pane_rows(lookups: DataFrame, seconds: int = 86400) -> DataFrame:
    """What lookups add to the panes of ``seconds`` that hold them, by domain and by hour."""
    step = seconds * 1_000_000
    micros = F.unix_micros(F.col("queried_at").cast("timestamp"))
    placed = lookups.withColumn("domain", normalize_domain(F.col("domain"))).withColumn("pane", F.floor(micros / step)).withColumn("edge", micros % step == 0)
    counts = [F.count("*").alias("n"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.min("queried_at").alias("first_at")]
    by_domain = placed.groupBy("device_id", "pane", "edge", "domain").agg(*counts).withColumn("kind", F.lit("domain")).withColumn("hour", F.lit(None).cast("timestamp_ntz"))
    by_hour = placed.groupBy("device_id", "pane", "edge", F.date_trunc("hour", "queried_at").alias("hour")).agg(*counts).withColumn("kind", F.lit("hour")).withColumn("domain", F.lit(None).cast("string"))
    names = [f.split(" ")[0] for f in PANE.split(", ")]
    return by_domain.select(*names).unionByName(by_hour.select(*names))


class Panes:
    """Panes of ``seconds`` in a batch ledger at ``path``; a batch holds whole panes and counts once however often it is added."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = 86400):
        self.spark, self.path, self.seconds = spark, path, seconds

    def add(self, lookups: DataFrame, batch_id: str) -> None:
        """Compute the panes of new lookups only."""
        rows = pane_rows(lookups, self.seconds)
        kinds = [f.split(" ") for f in PANE.split(", ")]
        ledger.write(rows.select(*[F.col(n).cast(k) for n, k in kinds]), self.path, batch_id, "panes")

    def samples(self, end: str, panes: int = 1, samples: int = 14) -> DataFrame:
        """What ``baseline.window_samples`` gives for windows of ``panes`` panes up to ``end``, a border of panes, from the panes alone."""
        step = self.seconds * 1_000_000
        last = F.floor(F.unix_micros(F.lit(end).cast("timestamp")) / step)
        rows = ledger.rows(self.spark, self.path, PANE).withColumn("back", last - F.col("pane")).filter((F.col("back") > 0) | ((F.col("back") == 0) & F.col("edge")))
        window = F.floor(F.col("back") / panes)
        border = F.when((F.col("back") % panes == 0) & (F.col("back") > 0), F.array(window, window - 1)).otherwise(F.array(window))
        idxs = F.when(F.col("edge"), border).otherwise(F.array(F.floor((F.col("back") - 1) / panes)))
        seen = rows.filter("kind = 'domain'").groupBy("device_id", "domain").agg(F.min("first_at").alias("first_seen"), F.array_distinct(F.flatten(F.collect_set(idxs))).alias("idxs"))
        start = F.timestamp_micros((last - (F.col("idx") + 1) * panes) * step).cast("timestamp_ntz")
        named = seen.withColumn("idx", F.explode("idxs")).filter(F.col("idx") < samples).groupBy("device_id", "idx")
        named = named.agg(F.count("domain").alias("domains"), F.count_if(F.col("domain").isNotNull() & (F.col("first_seen") >= start)).alias("new_domains"))
        hourly = rows.filter("kind = 'hour'").withColumn("idx", F.explode(idxs)).filter(F.col("idx") < samples).groupBy("device_id", "idx", "hour").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        none = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
        parts = hourly.select("device_id", "idx", "hour", "n", "blocked", *none("domains", "new_domains")).unionByName(named.select("device_id", "idx", F.lit(None).cast("timestamp_ntz").alias("hour"), *none("n", "blocked"), "domains", "new_domains"))
        volume, blocked = F.sum("n"), F.sum("blocked")
        return parts.groupBy("device_id", "idx").agg(
            volume.alias("dns_query_volume"), percent(blocked, volume).alias("blocked_query_pct"), F.sum("domains").alias("unique_domain_count"), F.sum("new_domains").alias("new_domain_count"),
            F.count("hour").alias("active_hour_count"), F.array_sort(F.collect_set(F.hour("hour"))).alias("hours"),
        )
