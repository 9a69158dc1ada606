"""Indexed first sightings and panes against the forms that read all history."""

import datetime as dt
import random
import re

import pytest

from homelens.operators import activity, baseline, panes

SCHEMA = "id long, device_id long, queried_at timestamp_ntz, domain string, status string"
END = "2024-03-20 00:00:00"


def drawn(spark, n=400):
    draw = random.Random(6)
    stop = dt.datetime.fromisoformat(END)
    at = lambda: stop - dt.timedelta(hours=draw.randrange(-2, 24 * 18), seconds=draw.choice([0, 0, 1, 1800]))
    rows = [(k, draw.choice([1, 2, 3, None]), at(), draw.choice(["A.example.", "b.example", "c", "d", None, *map(str, range(12))]), draw.choice(["blocked", "allowed"])) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def sets(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_panes_give_the_samples_of_whole_history(spark, tmp_path):
    rows = drawn(spark).cache()
    kept = panes.Panes(spark, str(tmp_path / "panes"))
    for low, high in (("2024-01-01", "2024-03-10"), ("2024-03-10", "2024-03-19"), ("2024-03-19", "2024-04-01"), ("2024-03-19", "2024-04-01")):
        kept.add(rows.filter(f"queried_at >= '{low}' AND queried_at < '{high}'"), f"from-{low}")
    for m, k in ((1, 14), (1, 3), (7, 2), (2, 5)):
        want = baseline.window_samples(rows, END, 86400 * m, k)
        got = kept.samples(END, m, k)
        assert sets(got.withColumn("idx", got["idx"].cast("int"))) == sets(want)


def test_the_index_gives_the_new_domains_and_history_stays_where_it_is(spark, tmp_path):
    rows = drawn(spark).filter("device_id IS NOT NULL AND domain IS NOT NULL").cache()
    index = panes.FirstSeen(spark, "first_seen_test", str(tmp_path / "index"), 4)
    cuts = ["2024-01-01", "2024-03-08", "2024-03-15", "2024-03-21"]
    for low, high in zip(cuts, cuts[1:]):
        window = rows.filter(f"queried_at >= '{low}' AND queried_at < '{high}'")
        unseen = index.unseen(window)
        plan = unseen._jdf.queryExecution().executedPlan().toString()
        fresh = index.extend(window)
        want = activity.new_domains(rows, f"{low} 00:00:00", f"{high} 00:00:00")
        assert sets(fresh.select("device_id", "domain")) == sets(want)
    assert index.extend(window).isEmpty()
    joined = plan[plan.index("SortMergeJoin") :].splitlines()
    depth = [len(re.match(r"[ :+\-|]*", x)[0]) for x in joined]
    sides = [k for k in range(1, len(joined)) if depth[k] == depth[1]]
    history = "\n".join(joined[sides[1] :])
    assert "first_seen_test" in history and "Exchange" not in history and "Bucketed: true" in history
    spark.sql("DROP TABLE first_seen_test")


@pytest.mark.parametrize("rows", [[]])
def test_no_rows(spark, tmp_path, rows):
    kept = panes.Panes(spark, str(tmp_path / "panes"))
    kept.add(spark.createDataFrame(rows, SCHEMA), "none")
    assert kept.samples(END).collect() == []
