"""Columns of a table that an operator does not read, kept out of the way of its own names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHERS = "_others"


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with the columns ``used`` and all others as one struct."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*[c for c in docs.columns if c in used], F.struct(*rest).alias(OTHERS) if rest else F.lit(None).cast("int").alias(OTHERS))


def unpacked(found: DataFrame, docs: DataFrame, *used: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs``, in their order, from what came of ``packed(docs, *used)``, and ``extra`` ones in place of or after them."""
    return found.select(*[F.col(c) if c in used else F.col(f"{OTHERS}.`{c}`").alias(c) for c in docs.columns if c not in extra], *extra)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``docs``."""
    known = {c.lower() for c in docs.columns}
    while name.lower() in known:
        name += "_"
    return name
