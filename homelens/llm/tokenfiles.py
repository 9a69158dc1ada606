"""Token-ID files with Elias-Fano document boundaries.

A file holds the ids of its documents one after the other (16 bits each where the vocabulary allows),
then two monotone sequences in Elias-Fano form, the documents' ids as steps from the first one and their end offsets: ``low_bits``
low bits of each offset packed, the rest as a unary bit string, and the place of every 256th one-bit so
that ``select`` reads one offset without decoding the others; readers take the starts and ends of a batch of
documents by one such select. Files are numbered in ascending order of doc_id, and so are the documents
within; rows with one doc_id are in the order of a hash of their text, so that a task that runs twice writes
the same. A task holds ``HELD`` ids at most before it closes a file.

Defined results: null text is empty (only the end id); null doc_id sorts first; repeated rows are
written as often as they occur; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homelens.llm import bytesets, storage, tokens
from homelens.llm.sizing import partitions_for, text_bytes

MAGIC = b"IDFILE02"
EVERY = 256
HELD = 64 << 20
FILES = 1 << 20
_NULL_ID = -(2**63)


class EliasFano:
    """A non-decreasing sequence below ``universe`` in about 2 + log2(universe / n) bits a value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        bits = np.empty((n, low_bits), np.uint8)
        for k in range(low_bits):
            bits[:, k] = values >> np.uint64(k) & np.uint64(1)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::EVERY].astype(np.uint64))

    def _low(self, i: int, k: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(k, np.uint64)
        first, last = i * self.low_bits, (i + k) * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: k * self.low_bits]
        return bits.reshape(k, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Value i, from the nearest sample on."""
        place = int(self.samples[i // EVERY])
        left, byte = i % EVERY, place // 8
        skip, span = place % 8, 64
        while True:
            bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + span], bitorder="little")[skip:])
            if len(bits) > left:
                return (byte * 8 + skip + int(bits[left]) - i << self.low_bits) | int(self._low(i, 1)[0])
            span *= 4

    def between(self, first: int, last: int) -> np.ndarray:
        """Values first to last - 1, by one select for many: the ones from the sample before the first to the sample after the last."""
        if first >= last:
            return np.empty(0, np.int64)
        lead = first // EVERY
        tail = -(-last // EVERY)
        begin = int(self.samples[lead]) // 8
        stop = int(self.samples[tail]) // 8 + 1 if tail < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:stop], bitorder="little")) + 8 * begin
        ones = ones[np.searchsorted(ones, int(self.samples[lead])) + first - lead * EVERY :][: last - first]
        return (((ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(first, last - first)).astype(np.int64)

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)).astype(np.int64)


def _parts(coded: EliasFano) -> tuple[bytes, list[np.ndarray]]:
    return struct.pack("<4q", coded.low_bits, len(coded.low), len(coded.high), len(coded.samples)), [coded.samples, coded.low, coded.high]


def _write(uri: str, ids: list[np.ndarray], doc_ids: np.ndarray, ends: np.ndarray, width: int) -> None:
    """A file of documents in ascending doc_id; those without one stand first and are only counted."""
    total = int(ends[-1]) if len(ends) else 0
    known = doc_ids[doc_ids != _NULL_ID].astype(np.int64)
    first = int(known[0]) if len(known) else 0
    steps = known.view(np.uint64) - np.uint64(first % 2**64)  # exact modulo 2^64, as the ids ascend
    names, places = EliasFano.encode(steps, int(steps[-1]) + 1 if len(steps) else 1), EliasFano.encode(ends, total + 1)
    head = MAGIC + struct.pack("<5q", len(doc_ids), total, width, len(doc_ids) - len(known), first)
    (name_head, name_parts), (place_head, place_parts) = _parts(names), _parts(places)
    storage.write_file(uri, head, name_head, place_head, *ids, b"\0" * (-total * width % 8), name_parts[0], place_parts[0], *name_parts[1:], *place_parts[1:])


class IdFile:
    """One token-ID file, memory-mapped."""

    def __init__(self, uri: str) -> None:
        raw = storage.map_array(uri, "u1")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"not a token-ID file: {uri}")
        n, total, width, nameless, first = struct.unpack("<5q", raw[8:48].tobytes())
        codes = [struct.unpack("<4q", raw[48 + 32 * k : 80 + 32 * k].tobytes()) for k in range(2)]
        at = 112 + total * width + (-total * width % 8)
        self.n_docs, self.n_ids = n, total
        self.nameless, self.first = nameless, first
        self.ids = raw[112 : 112 + total * width].view(f"<u{width}")
        samples = []
        for _, _, _, n_samples in codes:
            samples.append(raw[at : at + 8 * n_samples].view("<u8"))
            at += 8 * n_samples
        lists = []
        for size, (low_bits, n_low, n_high, _), marks in zip((n - nameless, n), codes, samples, strict=True):
            lists.append(EliasFano(size, low_bits, raw[at : at + n_low], raw[at + n_low : at + n_low + n_high], marks))
            at += n_low + n_high
        self.names, self.ends = lists

    def doc_ids(self, first: int, last: int) -> np.ndarray:
        """doc_id of documents first to last - 1, the least long where there is none."""
        none = max(0, min(last, self.nameless) - first)
        steps = self.names.between(max(0, first - self.nameless), max(0, last - self.nameless)).astype(np.uint64)
        return np.append(np.full(none, _NULL_ID), (steps + np.uint64(self.first % 2**64)).view(np.int64))

    def document(self, i: int) -> np.ndarray:
        """Ids of document i of this file, found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Starts of documents first to last - 1 and the end of the last one."""
        return self.ends.between(first - 1, last) if first else np.append(0, self.ends.between(0, last))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, size: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as files in ascending doc_id; returns (shard, uri, n_docs, n_ids), one row a file."""
    path = tokenizer or tokens.default_tokenizer()
    n = partitions_for(text_bytes(docs) if size is None else size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        partition, files = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        ids_of: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal files
            shard = partition * FILES + files
            uri = f"{folder}/shard-{shard:014d}.ids"
            ends = np.cumsum(np.concatenate(lengths))
            _write(uri, parts, np.concatenate(ids_of), ends, width)
            files += 1
            parts.clear(), ids_of.clear(), lengths.clear()
            return pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "n_docs": [len(ends)], "n_ids": [int(ends[-1])]}, schema=pa.schema([("shard", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for rows, _, _ in bytesets.pieces(batch, "text"):
                ids, bounds = encode.encode(rows.column("text").to_pylist())
                parts.append(ids.astype(f"<u{width}"))
                lengths.append(np.diff(bounds))
                ids_of.append(rows.column("doc_id").fill_null(_NULL_ID).to_numpy())
                if sum(map(len, parts)) > HELD:
                    yield close()
        if parts:
            yield close()

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("tid"))
    ordered = chosen.repartitionByRange(n, "doc_id", "tid").sortWithinPartitions("doc_id", "tid")
    return ordered.select("doc_id", "text").mapInArrow(write, "shard long, uri string, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame, per_row: int = 8192) -> DataFrame:
    """Documents of the files: (doc_id, start, n_tokens, ids_crc32). Starts count the ids of earlier files and documents.

    ``manifest`` has a row for each file, so the running total over it is small work.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = IdFile(uri)
                for k in range(0, file.n_docs, per_row):
                    last = min(k + per_row, file.n_docs)
                    marks = file.bounds(k, last)
                    sums = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]
                    doc = file.doc_ids(k, last)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64(), mask=doc == _NULL_ID), pa.array(before + marks[:-1]), pa.array(np.diff(marks)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = placed.select("uri", "before", "shard").repartition(placed.sparkSession.sparkContext.defaultParallelism * 4, "shard")
    return spread.select("uri", "before").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files into the shared folder, then read every document back from them."""
    folder = storage.shared_folder(docs.sparkSession, "token-files")
    manifest = storage.materialize(write_token_files(docs, folder, tokenizer), "token-manifest")
    return read_token_files(manifest)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """Token-ID files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
