"""Recorded files into batch ledgers: ``python -m homelens.replay KIND PATH STORE [BATCH]``.

KIND is ``dns`` (JSON envelopes), ``controller`` (a folder of clients.json and events.json) or ``syslog`` (text lines). A file set
replayed under the same batch name counts once; what cannot be read or normalized leaves a failed batch.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homelens.sources import controller, dns_log, ledger, syslog


def _payloads(rows: DataFrame) -> DataFrame:
    """All columns of normalized rows as one JSON text, with their error if they have one."""
    kept = [c for c in rows.columns if c != "error"]
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.to_json(F.struct(*kept)).alias("row"), error.alias("error"))


def replay(spark: SparkSession, kind: str, path: str, store: str, batch_id: str, now: str) -> bool:
    """Write the recorded files as one batch, clients and events of a controller as one; whether it succeeded."""
    try:
        if kind == "dns":
            rows = _payloads(dns_log.normalize_queries(dns_log.read_envelopes(spark, path))).withColumn("kind", F.lit("query"))
        elif kind == "controller":
            clients, events = controller.read_snapshot(spark, path, now)
            rows = _payloads(clients).withColumn("kind", F.lit("client")).unionByName(_payloads(events).withColumn("kind", F.lit("event")))
        elif kind == "syslog":
            rows = _payloads(syslog.parse_lines(syslog.read_lines(spark, path))).withColumn("kind", F.lit("line"))
        else:
            raise ValueError(f"not a kind of recording: {kind}")
    except Exception as failed:  # the files are not there or no such kind: a failed batch, as if the service had not answered
        ledger.record_failure(store, batch_id, kind, str(failed).split("\n")[0][:500], now)
        return False
    return ledger.append(rows.select("kind", "row", "error"), store, batch_id, kind, now)


ROW = "kind string, row string"


def main() -> int:
    from datetime import datetime, timezone

    from homelens.session import build_session

    kind, path, store, *name = sys.argv[1:]
    spark = build_session(app="replay")
    now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds")
    done = replay(spark, kind, path, store, name[0] if name else f"{kind}-{path.rstrip('/').rsplit('/', 1)[-1]}", now)
    ledger.batches(spark, store).orderBy(F.col("finished_at").desc()).show(5, truncate=False)
    return 0 if done else 1


if __name__ == "__main__":
    sys.exit(main())
