"""Batches that count as a whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from homelens.sources import ledger

SCHEMA = "id long, domain string"


def batch(spark, ids, bad=()):
    error = F.when(F.col("id").isin(*bad), F.concat(F.lit("no time in "), "id")) if bad else F.lit(None).cast("string")
    return spark.createDataFrame([(i, f"d{i}") for i in ids], SCHEMA).repartition(3).withColumn("error", error)


def kept(spark, path):
    return sorted(tuple(r) for r in ledger.rows(spark, path, SCHEMA).select("id", "domain", "batch_id").collect())


def status(spark, path):
    return {r["batch_id"]: (r["status"], r["records"], r["error"]) for r in ledger.batches(spark, path).collect()}


def test_whole_batches_once(spark, tmp_path):
    path = str(tmp_path / "dns")
    assert ledger.append(batch(spark, range(10)), path, "a/1", "dns_log", "2024-01-01T00:00:00")
    assert ledger.append(batch(spark, range(10)), path, "a/1", "dns_log")
    assert not ledger.append(batch(spark, range(10, 30), bad=[17]), path, "b", "dns_log")
    assert status(spark, path) == {"a/1": ("succeeded", 10, None), "b": ("failed", 0, "no time in 17")}
    assert kept(spark, path) == [(i, f"d{i}", "a/1") for i in range(10)]
    assert ledger.append(batch(spark, range(10, 30)), path, "b", "dns_log")
    assert not ledger.append(batch(spark, [99], bad=[99]), path, "b", "dns_log")  # failed after it had succeeded: changes nothing
    ledger.record_failure(path, "c", "dns_log", "no answer")
    ledger.append(batch(spark, []), path, "d", "dns_log")
    assert status(spark, path) == {"a/1": ("succeeded", 10, None), "b": ("succeeded", 20, None), "c": ("failed", 0, "no answer"), "d": ("succeeded", 0, None)}
    assert [x[0] for x in kept(spark, path)] == list(range(30))
    assert ledger.batches(spark, path).filter("batch_id = 'a/1'").first()["started_at"].isoformat() == "2024-01-01T00:00:00"


def test_a_batch_killed_before_its_commit_is_written_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "dns")
    staged = ledger._Batch({"path": path}, "a")
    staged.rows(iter(batch(spark, range(5)).drop("error").toArrow().to_batches()))  # data without a ledger file
    assert ledger.append(batch(spark, range(5)), path, "a", "dns_log")
    assert [x[0] for x in kept(spark, path)] == list(range(5)) and len(os.listdir(f"{path}/data")) > 1


def test_streamed_batches_once_over_restarts(spark, tmp_path):
    ledger.register(spark)
    lines, path, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).withColumn("domain", F.concat(F.lit("d"), "id")).coalesce(1).write.mode("append").parquet(lines)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(lines)
        options = {"path": path, "checkpointLocation": marks, "source": "dns_log"}
        stream.writeStream.format(ledger.FORMAT).options(**options).trigger(availableNow=True).start().awaitTermination()

    run()
    assert [x[0] for x in kept(spark, path)] == list(range(30)) and len(status(spark, path)) == 3
    last = max(os.listdir(f"{marks}/commits"), key=lambda x: x if x.isdigit() else "")
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{marks}/commits/{name}"):
            os.rename(f"{marks}/commits/{name}", f"{tmp_path}/{name}-lost")  # the stream dies after the sink's commit
    run()
    assert [x[0] for x in kept(spark, path)] == list(range(30)) and len(status(spark, path)) == 3


def test_overwrite_is_refused(spark, tmp_path):
    ledger.register(spark)
    with pytest.raises(Exception, match="only grows"):
        batch(spark, [1]).write.format(ledger.FORMAT).options(path=str(tmp_path), batch_id="x").mode("overwrite").save()
