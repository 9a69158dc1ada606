"""Equi joins whose hot keys are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 200_000
MOST_KEYS = 100_000


def hot_keys(rows: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """(keys, _shares): keys that more than ``hot`` rows and a 100,000th of all rows hold, and how many tasks share each.

    There are ``MOST_KEYS`` of them at most whatever the number of rows, so they may be broadcast.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least = F.greatest(F.lit(float(hot)), F.sum("_n") / MOST_KEYS).alias("_least")
    found = counts.crossJoin(F.broadcast(counts.agg(least))).filter("_n > _least")  # one row
    return found.select(*keys, F.ceil(F.col("_n") / F.col("_least")).cast("int").alias("_shares"))


def dealt_join(large: DataFrame, small: DataFrame, keys: list[str], by: str, hot: int = HOT, how: str = "inner") -> DataFrame:
    """Inner or left join on ``keys``. Rows of ``large`` that hold a hot key are dealt over shares by a hash of ``by``, and the
    few rows of ``small`` with that key go to each share."""
    some = F.broadcast(hot_keys(large, keys, hot))
    share = F.coalesce(F.pmod(F.xxhash64(by), F.col("_shares")).cast("int"), F.lit(0))
    left = large.join(some, keys, "left").withColumn("_share", share).drop("_shares")
    shares = F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1)
    right = small.join(some, keys, "left").withColumn("_share", F.explode(shares)).drop("_shares")
    return left.join(right, [*keys, "_share"], how).drop("_share")
