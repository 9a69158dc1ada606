"""The loop that evaluates rules on each micro-batch and keeps findings, exactly once.

Findings, suppressions, audit rows and the events of new findings are rows of one batch ledger: what a micro-batch changes is one
write under the batch's number, so after a restart in mid-batch the same number comes again and either finds its
rows there or writes them whole. Mutable rows are versions; the last one of a fingerprint counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from homelens.operators import events, feedback
from homelens.sources import ledger

FINDING = "fingerprint string, rule_id string, severity string, confidence string, subject_label string, device_id long, occurred_at timestamp_ntz, n long, summary string, domains array<string>, pattern string, status string, created boolean"
ROW = f"kind string, {FINDING}, matching_key string, before string, after string, version long"


class FindingStore:
    """Findings below ``path``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        ledger.register(spark)  # a stream works in a copy of the session, made when it starts

    def rows(self, kind: str) -> DataFrame:
        return ledger.rows(self.spark, self.path, ROW).filter(F.col("kind") == kind).drop("kind", "batch_id")

    def findings(self) -> DataFrame:
        """The last version of each finding."""
        return feedback.latest_version(self.rows("finding").drop("matching_key", "before", "after"), ["fingerprint"])

    def suppressions(self) -> DataFrame:
        return self.rows("suppression").select("matching_key").distinct()

    def events(self) -> DataFrame:
        """An event for each finding when it is new, from the write that made it."""
        return events.finding_events(self.rows("finding").filter("created"))

    def done(self, batch_id: str) -> bool:
        return not ledger.batches(self.spark, self.path).filter((F.col("batch_id") == batch_id) & (F.col("status") == ledger.SUCCEEDED)).isEmpty() if ledger.exists(self.path) else False

    def _write(self, rows: DataFrame, batch_id: str, version: int, source: str) -> None:
        known = {f.name for f in rows.schema}
        typed = [f.split(" ", 1) for f in ROW.split(", ")]
        full = [F.lit(version).cast("long").alias(n) if n == "version" else (F.col(n) if n in known else F.lit(None)).cast(kind).alias(n) for n, kind in typed]
        ledger.write(rows.select(*full), self.path, batch_id, source)

    def refresh(self, drafts: DataFrame, batch_id: str, version: int) -> None:
        """Keep the drafts that are not suppressed: new ones open, known ones refreshed, closed ones as they are."""
        if self.done(batch_id):
            return
        key = feedback.suppression_key(F.col("rule_id"), F.col("device_id"), F.lit(None), F.col("pattern"))
        once = drafts.dropDuplicates(["fingerprint"]).withColumn("matching_key", key)
        heard = feedback.suppress(once, self.suppressions()).drop("matching_key")
        self._write(feedback.finding_upsert(heard, self.findings()).withColumn("kind", F.lit("finding")), batch_id, version, "findings")

    def classify(self, said: DataFrame, batch_id: str, version: int) -> None:
        """Statuses, suppressions and audit rows of a person's classifications (fingerprint, classification) as one write."""
        if not self.done(batch_id):
            self._write(feedback.feedback_write(said, self.findings().drop("version"), self.suppressions()), batch_id, version, "feedback")


def start(
    stream: DataFrame, store: FindingStore, evaluate: Callable[[DataFrame, int], DataFrame], checkpoint: str, every: str | None = "60 seconds", name: str = "evaluation"
) -> StreamingQuery:
    """Evaluate the rules on each micro-batch and keep what they find; ``evaluate`` gets the batch and its number and returns drafts.

    Without ``every`` the stream takes what is there and stops. ``evaluate`` must give the same drafts for the same batch.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch_id = f"{name}-{number:012d}"
        if not store.done(batch_id) and not batch.isEmpty():
            store.refresh(evaluate(batch, number), batch_id, number)

    writer = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
