"""Vector compression by integer codebooks, one for each of ``PARTS`` equal parts of a vector.

Components become integers, floor(256 * x). The codebooks, at most ``ENTRIES`` entries a part, are broadcast each
round; tasks compute all squared distances of an Arrow batch by norm expansion, |x|^2 - 2 x.c + |c|^2, in
exact int64 products, and take the first smallest. Each task sends one sum and count for each entry and position, which
a grouped shuffle adds up; what the driver gets is the codebooks and their sums, whatever the number of vectors.

Defined results: vectors that are null or hold null or non-finite components are left out; vectors are
filled up with zeros to a common multiple of ``PARTS``; a null vec_id comes after all others when codebooks start, and
equal ids are in the order of their vectors; with fewer than ``ENTRIES`` vectors a codebook has as many entries
as there are vectors; integers from 2^62 on are taken as 2^62, and where any is so large that int64 could overflow, a task
computes in unbounded integers and an error above the largest long is that long; repeated rows come out as often; an empty
table gives no rows; other columns are ignored. Vectors are numbers, so there are no long texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homelens.llm import storage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
STEP = 4096
HOT = 1000
LARGEST = 2**63 - 1
SUMS = "part int, entry int, place int, total decimal(38,0), n long"


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of all components: (rows, PARTS, width), int64, or Python's integers if products could overflow."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    counts = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.zeros((len(counts), PARTS * width))
    row = np.repeat(np.arange(len(counts)), counts)
    whole[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(whole * SCALE), -(2.0**62), 2.0**62)
    out = whole.astype(np.int64).reshape(len(counts), PARTS, width)
    return out if _small(out, width) else out.astype(object)


def _small(values: np.ndarray, width: int) -> bool:
    """Whether squared distances between such values fit into int64."""
    most = max((abs(int(x)) for x in (values.max(), values.min())), default=0) if values.size else 0
    return 8 * width * most * most < 2**63


def _nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, squared distance) of each row; both sides are of one integer type."""
    far = (part * part).sum(1)[:, None] - 2 * (part @ book.T) + (book * book).sum(1)
    code = far.argmin(1)
    return code, far[np.arange(len(part)), code]


def _pairs(vectors: pa.Array, books: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its rows, nearest entries, squared distances) of every part of some vectors."""
    whole = _integers(vectors, width)
    if whole.dtype == object or not _small(books, width):
        whole, books = whole.astype(object), books.astype(object)
    for k in range(PARTS):
        part = whole[:, k, :]
        yield k, part, *_nearest(part, books[k])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            yield batch.slice(k, STEP)


def _sums(kept: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(part, entry, place, total, n) of the vectors' parts by their nearest entry, added up over all tasks."""
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.shape, object)
        count = np.zeros(sent.value.shape[:2], np.int64)
        for batch in _steps(batches):
            for k, part, code, _ in _pairs(batch.column("vector"), sent.value, width):
                order = np.argsort(code, kind="stable")
                of, first = np.unique(code[order], return_index=True)
                total[k, of] += np.add.reduceat(part[order], first, 0).astype(object)
                count[k] += np.bincount(code, minlength=count.shape[1])
        used = np.argwhere(count > 0)
        rows = [(k, e, p, Decimal(int(total[k, e, p])), int(count[k, e])) for k, e in used.tolist() for p in range(width)]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "entry", "place", "total", "n"])

    sums = kept.select("vector").mapInArrow(add, SUMS).groupBy("part", "entry", "place")
    return sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def learn(kept: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width) after ``rounds`` rounds over all vectors."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).toArrow()
    column = first.column("vector").combine_chunks()
    books = _integers(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for part, entry, place, total, n in _sums(kept, books, width).collect():  # PARTS * ENTRIES * width rows at most
            books[part, entry, place] = int(total) // n
    return books


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code, error) of all vectors."""
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            codes = np.empty((batch.num_rows, PARTS), np.uint8)
            error = np.zeros(batch.num_rows, object)
            for k, _, code, far in _pairs(batch.column("vector"), sent.value, width):
                codes[:, k] = code
                error = error + far
            names = [row.tobytes().hex() for row in codes]
            error = [min(int(e), LARGEST) for e in error]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "vector").mapInArrow(assign, f"vec_id long, label {kind}, code string, error long")


def label_totals(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors of equal labels added up, nulls together.

    The few labels that more than ``HOT`` rows and a thousandth of all hold, 1000 at most, are joined by broadcast, the others by shuffle.
    """
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    totals = storage.materialize(totals.withColumn("label_error", F.least("total", F.lit(LARGEST).cast("decimal(38,0)")).cast("long")), "label-totals")
    rows = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(HOT, rows // 1000)
    known = lambda some: some.select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    few = F.broadcast(known(totals.filter(hot)))
    return coded.join(few, same).unionByName(coded.join(few, same, "left_anti").join(known(totals.filter(~hot)).hint("merge"), same)).drop("_label")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of the rows (vec_id, embedding, label)."""
    vector = F.col("embedding").cast("array<double>")
    fit = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector")).filter(F.coalesce(fit, F.lit(False)))
    kept = storage.materialize(kept, "vectors")  # read once a round
    longest = kept.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    width = max(1, -(-longest // PARTS))
    books = learn(kept, width, rounds)
    return storage.materialize(encode(kept, books, width), "codes"), books


def op11_integer_codebooks(spark, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their squared errors, and the errors of each label."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = label_totals(coded).withColumn("codebooks_sha256", F.lit(digest(books)))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_PART = "list_transform(range(0, 16), lambda p: list_transform(embedding[p * (len(embedding) // 16) + 1:(p + 1) * (len(embedding) // 16)], lambda x: floor(256 * x::DOUBLE)::BIGINT))"


def _round(k: int) -> str:
    far = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.c[i]) * (v.x[i] - b.c[i])))::BIGINT"
    return f"""
near{k} AS (
  SELECT v.vec_id, v.label, v.part, v.x, min(struct_pack(far := {far}, entry := b.entry)) AS best
  FROM parts v JOIN book{k} b ON v.part = b.part GROUP BY ALL)"""


def _moved(k: int) -> str:
    return f"""
sums{k} AS (
  SELECT part, best.entry AS entry, i, sum(x[i])::HUGEINT AS total, count(*) AS n
  FROM near{k}, range(1, (SELECT max(len(x)) + 1 FROM parts)) r(i) GROUP BY ALL),
book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(s.c, b.c) AS c
  FROM book{k} b LEFT JOIN (
    SELECT part, entry, list((CASE WHEN total >= 0 THEN total // n ELSE -((n - 1 - total) // n) END)::BIGINT ORDER BY i) AS c
    FROM sums{k} GROUP BY ALL) s ON b.part = s.part AND b.entry = s.entry)"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, {_PART} AS cut FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p AS part, cut[p + 1] AS x FROM kept, range(0, 16) r(p)),
book0 AS (
  SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::BIGINT AS entry, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_round(0)}, {_moved(0)}, {_round(1)}, {_moved(1)}, {_round(2)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error
  FROM near2 GROUP BY vec_id, label),
named AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, named
"""
