"""Structured Streaming forms: live events without repeats, line files, source silence, and scheduled evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from homelens.sources import syslog


def stream_lines(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Parsed lines of text files as they arrive; offsets in the checkpoint take the place of a poll mark."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return syslog.parse_lines(lines.filter("trim(value) <> '' AND NOT startswith(trim(value), '#')"))


def stream_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Parsed lines from a TCP socket. It cannot be read again after a failure: for trials; let a relay write files otherwise."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return syslog.parse_lines(lines.filter("trim(value) <> ''"))


def stream_table(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def distinct_events(events: DataFrame, id_column: str = "id", ts: str = "occurred_at", delay: str = "24 hours") -> DataFrame:
    """Each event once; state is kept for the evaluation window, so later repeats within it are dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_column])


def blocked_counts(lookups: DataFrame, window: str = "15 minutes", slide: str = "5 minutes", delay: str = "24 hours") -> DataFrame:
    """Blocked lookups of each device in sliding windows; late rows count for a day."""
    return lookups.withWatermark("queried_at", delay).filter("status = 'blocked'").groupBy(F.window("queried_at", window, slide), "device_id").agg(F.count("*").alias("blocked"))


def evaluate_batches(stream: DataFrame, plan: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """Run a batch plan on each micro-batch; a repeated batch has the same number, so its writer can skip it."""
    return stream.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def largest_spans(events: DataFrame, key: str, ts: str, seconds: int, delay: str = "24 hours") -> DataFrame:
    """(key, n, last) each time a key's largest number of events within ``seconds`` grows, as the batch form finds it.

    The state of a key is the times of its last ``seconds`` and its best count so far. Events of a key are taken
    in the order of their times within a batch; use with output mode ``append``.
    """

    def grow(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, best = state.get if state.exists else ([], 0)
        times, found = list(times), []
        for t in sorted(x for f in frames for x in f["_t"]):
            times = [x for x in times if x >= t - seconds * 1_000_000] + [t]
            if len(times) > best:
                best = len(times)
                found.append((keys[0], best, t))
        state.update((times, best))
        yield pd.DataFrame(found[-1:], columns=[key, "n", "last_micros"])

    kind = events.schema[key].dataType.simpleString()
    timed = events.withWatermark(ts, delay).select(key, ts, F.unix_micros(F.col(ts)).alias("_t"))
    return timed.groupBy(key).applyInPandasWithState(grow, f"{key} {kind}, n long, last_micros long", "times array<long>, best long", "append", "NoTimeout")


def silent_sources(lines: DataFrame, now: str, stale: int) -> DataFrame:
    """(source, last_line_at, silent) of each source's lines (source, seen_at): silent after ``stale`` seconds without one."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_line_at").cast("timestamp"))
    return lines.groupBy("source").agg(F.max("seen_at").alias("last_line_at")).withColumn("silent", age >= stale)
