"""Best-two-fit packing of whole documents into sequences of a fixed number of tokens.

Sequences are planned on the histogram of piece lengths, which has no more entries than a sequence has
tokens however large the corpus. A plan step fills one bin greedily with the largest lengths that fit;
where a gap stays, the bin's smallest document makes way for the two unpacked documents that fill the
expanded gap best. The bin is repeated as often as its lengths last. Pieces then take the planned places
by their rank among the pieces of equal length; ranks are counted within salted groups and shifted by
the totals of the groups before.

Defined results: null text is a document of only the end id; repeated rows and ties are separate pieces;
an empty table gives no rows; other columns are ignored. A document over the limit is cut from its end
into full pieces, the first one taking what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homelens.llm import bytesets, storage, tokens

SEQUENCE = 2048
RANKED = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, limit: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of all documents, encoded where they are read."""
    path = tokenizer or tokens.default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in batches:
            for rows, _, _ in bytesets.pieces(batch, "text"):
                ids, bounds = encode.encode(rows.column("text").to_pylist())
                raw = ids.astype("<u4").tobytes()
                out: list[tuple] = []
                for doc, a, b in zip(rows.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    full, first = divmod(b - a, limit)
                    marks = [a, *range(a + first if first else a + limit, b + 1, limit)]
                    out += [(doc, k, x - a, y - x, zlib.crc32(raw[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(marks, marks[1:], strict=False))]
                doc_ids, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def _largest(free: np.ndarray) -> np.ndarray:
    """For each x the largest length up to x of which some are free, or 0."""
    return np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))


def best_two_fit(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: times in the bin}, number of such bins) for histogram[length] pieces of each length."""
    free = histogram.astype(np.int64).copy()
    free[0] = 0
    limit = len(free) - 1
    plan = []
    while free.any():
        left, gap, filled = free.copy(), limit, {}
        while (length := int(_largest(left[: gap + 1])[gap])) > 0:
            times = int(min(left[length], gap // length))
            filled[length] = filled.get(length, 0) + times
            left[length] -= times
            gap -= times * length
        if gap and len(filled) + max(filled.values()) > 2:  # swaps of a lone document gave no fewer bins in trials
            smallest = min(filled)
            room = gap + smallest
            back = left[: room + 1].copy()
            back[smallest] += 1
            near = _largest(back)
            a = np.flatnonzero(back)
            b = near[np.minimum(a, room - a)]
            same = (a == b) & (back[a] < 2)
            b = np.where(same, near[np.maximum(b - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > smallest:
                pick = int(total.argmax())
                filled[smallest] -= 1
                for x in (int(a[pick]), int(b[pick])):
                    filled[x] = filled.get(x, 0) + 1
                filled = {x: k for x, k in filled.items() if k}
        bins = min(int(free[x]) // k for x, k in filled.items())
        for x, k in filled.items():
            free[x] -= bins * k
        plan.append((filled, bins))
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Slots of the plan as runs of ranks for each length, sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for filled, bins in plan:
        offset = 0
        for length, k in sorted(filled.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, sequence, k, offset))
            used[length] = first + bins * k
            offset += k * length
        sequence += bins
    rows.sort()
    names = ("length", "first", "sequence", "times", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(pieces: DataFrame, limit: int = SEQUENCE, salts: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset; only the histogram of lengths (``limit`` rows) reaches the driver.

    Pieces of one length are ranked in ``salts`` parts, by default one for each ``RANKED`` pieces there are, since most may have one length.
    """
    salts = salts or max(256, pieces.count() // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = storage.materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-groups")
    histogram = np.zeros(limit + 1, np.int64)
    for row in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    places = _places(best_two_fit(histogram))
    key = (places["length"] << 48) | places["first"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(key, (size << 48) | r, "right") - 1
        nth = r - places["first"][at]
        times = places["times"][at]
        return pd.DataFrame({"sequence_id": places["sequence"][at] + nth // times, "offset": places["offset"][at] + nth % times * size})

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within)).join(shifts, ["length", "salt"])
    put = ranked.withColumn("place", place("length", F.col("shift") + F.col("nth") - 1))
    return put.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, limit: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``limit`` tokens."""
    return pack(storage.materialize(token_pieces(docs, limit, tokenizer), "token-pieces"), limit)


def op4_best_two_fit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
