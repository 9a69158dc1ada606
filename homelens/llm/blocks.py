"""Documents packed into blocks and written once: one row a block, so that every later step sees the same ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homelens.llm import storage

LAST = 2**63 - 1
BLOCKS = "block long, ids binary, sizes binary, texts binary"
_ZSTD = pa.Codec("zstd", compression_level=5)
_SCHEMA = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])


def squeezed(raw: bytes) -> bytes:
    return _ZSTD.compress(raw, asbytes=True) if raw else b""


def unsqueezed(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b""


def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(doc_ids, ``LAST`` where there is none; bytes of each text; all texts) of a block."""
    ids, sizes = (np.frombuffer(table.column(c)[0].as_py(), "<i8") for c in ("ids", "sizes"))
    return ids, sizes, unsqueezed(table.column("texts")[0].as_py(), int(sizes.sum()))


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents, about ``most`` bytes each, numbered by task."""
    task, made = TaskContext.get().partitionId() << 32, 0
    texts: list[bytes] = []
    ids: list[int] = []
    size = 0

    def closed() -> pa.RecordBatch:
        nonlocal made
        made += 1
        sizes = np.array([len(t) for t in texts], "<i8")
        row = (task + made, np.array(ids, "<i8").tobytes(), sizes.tobytes(), squeezed(b"".join(texts)))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            texts.append(text.as_py().encode())
            ids.append(LAST if doc_id is None else doc_id)
            size += len(texts[-1]) + 16
            if size > most:
                yield closed()
                texts, ids, size = [], [], 0
    if texts:
        yield closed()


def pack(docs: DataFrame, most: int, name: str) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text), about ``most`` bytes each; a longer text is a block of its own. Null text is empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return storage.materialize(texts.mapInArrow(lambda batches: _packed(batches, most), BLOCKS), name, {"parquet.block.size": str(16 << 20)})
