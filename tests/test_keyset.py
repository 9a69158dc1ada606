"""A stream by (created, id): equal times, page sizes, restarts, lost commits, unsorted files."""

import datetime as dt
import os
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from homelens.sources import keyset

T0 = dt.datetime(2024, 2, 1)
SCHEMA = "created_at timestamp_ntz, id long, name string"


def add(spark, folder, rows, files=2):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, rows=7):
    keyset.register(spark)
    options = {"path": f"{folder}/in", "created": "created_at", "id": "id", "rows": str(rows), "mark": f"{folder}/mark"}
    stream = spark.readStream.format(keyset.FORMAT).schema(SCHEMA).options(**options).load()

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/marks").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def seen(spark, folder):
    return spark.read.parquet(*[f"{folder}/out/{k}" for k in os.listdir(f"{folder}/out")]).collect()


def test_every_row_once_in_order(spark, tmp_path):
    folder = str(tmp_path)
    draw = random.Random(1)
    rows = [(T0 + dt.timedelta(seconds=k // 9), k, f"n{k}") for k in range(60)]  # nine rows share each time
    first, second = rows[:40], rows[40:]
    draw.shuffle(first)
    add(spark, folder, first, 3)
    run(spark, folder)
    assert sorted(r["id"] for r in seen(spark, folder)) == list(range(40))
    add(spark, folder, second)
    run(spark, folder)  # restarted
    got = seen(spark, folder)
    assert sorted(r["id"] for r in got) == list(range(60))
    by = {}
    for r in got:
        by.setdefault(r["batch"], []).append((r["created_at"], r["id"]))
    pages = [sorted(by[k]) for k in sorted(by)]
    assert [x for page in pages for x in page] == [(t, i) for t, i, _ in rows]
    assert max(map(len, pages)) == 7
    last = max(int(k) for k in os.listdir(f"{folder}/marks/commits") if k.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.rename(f"{folder}/marks/commits/{name}", f"{folder}/{name}-lost")
    run(spark, folder)  # the last batch again, with the same rows
    assert sorted(r["id"] for r in seen(spark, folder)) == list(range(60))


def test_row_groups_outside_the_page_are_not_opened(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(4):
        add(spark, folder, [(T0 + dt.timedelta(days=k, seconds=i), 100 * k + i, "x") for i in range(10)], 1)
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = keyset.KeysetStream({"path": f"{folder}/in", "created": "created_at", "id": "id", "rows": "12", "mark": f"{folder}/mark"}, schema)
    opened = []
    stream._keys = lambda file, group, start, plain=stream._keys: opened.append(file) or plain(file, group, start)
    end = stream.latestOffset()
    assert len(opened) == 2 and end["id"] == 101
    parts = stream.partitions(keyset.FIRST, end)
    assert len(parts) == 2 and sum(b.num_rows for p in parts for b in stream.read(p)) == 12
    again = stream.latestOffset()
    assert again["id"] == 203 and len(stream.partitions(end, again)) == 2 and stream.partitions(end, end) == []


@pytest.mark.parametrize("rows", [[], [(None, 1, "x"), (T0, 2, None)]])
def test_nulls_and_no_rows(spark, tmp_path, rows):
    folder = str(tmp_path)
    add(spark, folder, rows, 1)
    os.makedirs(f"{folder}/out")
    run(spark, folder)
    batches = os.listdir(f"{folder}/out")
    assert [r["id"] for r in (seen(spark, folder) if batches else [])] == [2] * bool(rows)


@pytest.mark.parametrize("held, ranges, most", [(1, 4, 10), (3, 2, 17), (5, 1 << 16, 60), (1, 3, 1), (2, 8, 500)])
def test_the_end_of_a_page_is_found_by_counting(spark, tmp_path, monkeypatch, held, ranges, most):
    """As many keys as ``HELD`` are sorted at once, whatever the page; pages are those of all keys in order."""
    folder, draw = str(tmp_path), random.Random(most)
    rows = [(draw.choice([None, *(T0 + dt.timedelta(seconds=9 ** draw.randrange(6)) for _ in range(9))]), draw.choice([None, -(2**63), 2**63 - 1, *range(-40, 40)]), "x") for _ in range(150)]
    add(spark, folder, rows + [(T0, 5, "x")] * 30, 3)
    monkeypatch.setattr(keyset, "HELD", held, raising=False)
    monkeypatch.setattr(keyset, "RANGES", ranges, raising=False)
    stream = keyset.KeysetStream({"path": f"{folder}/in", "created": "created_at", "id": "id", "rows": str(most), "mark": f"{folder}/mark"}, spark.createDataFrame([], SCHEMA).schema)
    micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    keys = sorted((micros(t), i) for t, i, _ in rows + [(T0, 5, "x")] * 30 if t is not None and i is not None)
    last = (-(2**63), -(2**63))
    while left := [k for k in keys if k > last]:
        end = stream.latestOffset()
        assert (end["created"], end["id"]) == left[:most][-1]
        last = left[:most][-1]
    assert stream.latestOffset() == end


def test_memory_of_the_driver_does_not_follow_the_page(spark, tmp_path):
    """Two million keys in one page: what the driver holds at once stays far below them."""
    folder = str(tmp_path)
    at = "TIMESTAMP_NTZ '2024-02-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, pmod(id * 7919, 2000))"
    spark.range(2_000_000).selectExpr(f"{at} AS created_at", "id", "'x' AS name").repartition(2).write.parquet(f"{folder}/in")
    stream = keyset.KeysetStream({"path": f"{folder}/in", "created": "created_at", "id": "id", "rows": "1500000", "mark": f"{folder}/mark"}, spark.createDataFrame([], SCHEMA).schema)
    tracemalloc.start()
    try:
        end = stream.latestOffset()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert end["created"] == (1706745600 + 1499) * 1_000_000 and end["id"] == max(i for i in range(1_990_000, 2_000_000) if i * 7919 % 2000 == 1499)
    assert most < 60e6
