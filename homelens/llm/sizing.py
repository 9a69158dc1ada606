"""How many partitions a job takes, from the size of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one small aggregate over the column."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def partitions_for(size: int, small: int = 16 << 20, large: int = 256 << 20) -> int:
    """One partition for each ``small`` bytes up to 4096, then for each ``large`` bytes."""
    return int(max(12, min(4096, size / small), size / large))
