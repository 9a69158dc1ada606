"""Slices of a stream are written by as many tasks as their rows are read by."""

from pathlib import Path

from homelens.plans import stateful


def test_a_slice_has_a_file_for_each_part(spark, tmp_path):
    rows = spark.range(0, 90, 1, 3).selectExpr("id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 30 AS int)) AS at")
    folder = str(tmp_path / "rows")
    files = [len(list(Path(folder).glob("*.parquet"))) for _ in stateful._slices(folder, rows, "at", ["2024-01-10 00:00:00", "2024-01-20 00:00:00"])]
    assert files == [3, 6, 9]
    assert sorted(r["id"] for r in spark.read.parquet(folder).collect()) == list(range(90))
