"""Findings of a stream: kept once over restarts, never reopened, with their events and a person's classifications."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from homelens.operators import findings
from homelens.sources import ledger
from homelens.streaming import finding_loop

T0 = dt.datetime(2024, 4, 1)
LOOKUP = "id long, device_id long, queried_at timestamp_ntz, domain string, status string"


def lookups(first, device, n, minute):
    return [(first + k, device, T0 + dt.timedelta(minutes=minute, seconds=k), f"d{k}.ads.example", "blocked") for k in range(n)]


def add(spark, folder, rows):
    spark.createDataFrame(rows, LOOKUP).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, store, fail=False):
    schema = spark.createDataFrame([], LOOKUP).schema

    def evaluate(batch, number):
        upto = spark.read.schema(schema).parquet(f"{folder}/in").filter(F.col("queried_at") <= batch.agg(F.max("queried_at")).first()[0])
        return findings.rule_blocked_burst(upto)

    stream = spark.readStream.schema(LOOKUP).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    finding_loop.start(stream, store, evaluate, f"{folder}/marks", None).awaitTermination()


@pytest.fixture()
def loop(spark, tmp_path):
    folder = str(tmp_path)
    store = finding_loop.FindingStore(spark, f"{folder}/findings")
    add(spark, folder, lookups(0, 1, 6, 0) + lookups(50, 2, 3, 0))
    run(spark, folder, store)
    return folder, store


def state(store):
    return {r["fingerprint"]: (r["device_id"], r["status"], r["n"]) for r in store.findings().collect()}


def test_findings_are_new_once(spark, loop):
    folder, store = loop
    (mark,) = state(store)
    assert state(store)[mark] == (1, "open", 6)
    add(spark, folder, lookups(10, 1, 2, 1) + lookups(60, 2, 6, 2))
    run(spark, folder, store)
    found = state(store)
    assert sorted(found.values()) == [(1, "open", 8), (2, "open", 9)]
    assert sorted(r["device_id"] for r in store.events().collect()) == [1, 2]
    row = store.findings().filter("device_id = 1").first()
    assert row["domains"] == [f"d{k}.ads.example" for k in range(6)] and row["pattern"] == "*.ads.example"
    # the stream dies after the write and before its own commit: the batch comes again
    last = max(int(k) for k in os.listdir(f"{folder}/marks/commits") if k.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.rename(f"{folder}/marks/commits/{name}", f"{folder}/{name}-lost")
    run(spark, folder, store)
    assert state(store) == found and store.events().count() == 2 and store.rows("finding").count() == 3


def test_a_batch_that_died_in_its_write_is_written_whole(spark, loop):
    folder, store = loop
    before = state(store)
    add(spark, folder, lookups(60, 2, 6, 2))
    staged = ledger._Batch({"path": store.path, "source": "findings"}, "evaluation-000000000001")
    rows = ledger.rows(spark, store.path, finding_loop.ROW).drop("batch_id").toArrow().to_batches()
    staged.rows(iter(rows))  # data without a ledger file
    run(spark, folder, store)
    assert len(state(store)) == 2 and store.events().count() == 2 and before.items() <= state(store).items()


def test_classifications_are_one_write_and_findings_are_not_reopened(spark, loop):
    folder, store = loop
    (mark,) = state(store)
    said = spark.createDataFrame([(mark, "suppress_similar"), ("unknown", "resolve")], "fingerprint string, classification string")
    store.classify(said, "said-1", 1)
    store.classify(said, "said-1", 1)  # repeated
    assert state(store)[mark] == (1, "dismissed", 6)
    key = "blocked_query_burst|device:1|*.ads.example"
    assert [r["matching_key"] for r in store.suppressions().collect()] == [key]
    audit = sorted((r["before"] or "", r["after"]) for r in store.rows("audit").collect())
    assert len(audit) == 2 and audit[1] == ('{"status":"open"}', '{"status":"dismissed","classification":"suppress_similar"}') and key in audit[0][1]
    assert ledger.batches(spark, store.path).filter("source = 'feedback'").count() == 1
    add(spark, folder, lookups(10, 1, 4, 1) + lookups(70, 1, 6, 40))  # the same span again, and a later one of the muted kind
    run(spark, folder, store)
    assert state(store) == {mark: (1, "dismissed", 6)} and store.events().count() == 1
    store.classify(said, "said-2", 2)
    assert store.rows("suppression").count() == 1
