"""A table that takes whole batches or nothing: data files of task attempts, and a ledger of batches.

Tasks write their rows as Parquet under ``data/attempt=<name>``. Only the commit on the driver makes them count, by one
ledger file that names the attempts; it appears whole. A batch that is written again after it succeeded leaves the ledger as
it is, so its rows are there once however often it is repeated, also after a crash between data and ledger. One row
with an ``error`` fails its task, and the abort leaves one failed row with no records; a later attempt may still
succeed. Readers join the data with the succeeded attempts, so files of other attempts are never seen.

Batches are named by option ``batch_id``; a stream's batches are named by its number, after the same option where it is given.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

FORMAT = "batch_ledger"
SUCCEEDED, FAILED = "succeeded", "failed"
ENTRY = "batch_id string, source string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, records long, error string, attempts array<string>"


def filesystem(uri: str):
    """(file system, path in it) of a URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if urlparse(uri).scheme == "file":
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    records: int


class _Batch:
    """The writing of one batch."""

    def __init__(self, options: dict, batch_id: str):
        self.path, self.source = options["path"].rstrip("/"), options.get("source", "")
        self.batch_id = batch_id
        self.started = options.get("started_at") or datetime.now(timezone.utc).replace(tzinfo=None).isoformat()

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Write a task's rows as one file; a row with an error fails the task."""
        import pyarrow.parquet as pq

        attempt = uuid.uuid4().hex  # a task that runs twice leaves two files, of which the ledger names one
        system, folder = filesystem(f"{self.path}/data/attempt={attempt}")
        out, records, file = None, 0, f"{folder}/rows.parquet"
        try:
            for batch in batches:
                if "error" in batch.schema.names:
                    bad = batch.column("error").drop_null()
                    if len(bad):
                        raise ValueError(f"batch {self.batch_id} rejected: {bad[0].as_py()}")
                    batch = batch.drop_columns(["error"])
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = pq.ParquetWriter(system.open_output_stream(file), batch.schema)
                out.write_batch(batch)
                records += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                system.delete_dir(folder)
            raise
        if out is not None:
            out.close()
        return Written(attempt, records)

    def enter(self, status: str, messages: list[Written], error: str | None) -> None:
        """Write the ledger file of this batch, unless it succeeded before."""
        system, folder = filesystem(f"{self.path}/ledger")
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{quote(self.batch_id, safe='')}.json"
        if system.get_file_info(name).is_file:
            with system.open_input_stream(name) as there:
                if json.loads(there.read())["status"] == SUCCEEDED:
                    return
        entry = {"batch_id": self.batch_id, "source": self.source, "started_at": self.started, "finished_at": datetime.now(timezone.utc).replace(tzinfo=None).isoformat(), "status": status, "records": sum(m.records for m in messages), "error": error, "attempts": [m.attempt for m in messages if m.records]}
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(entry).encode())
        system.move(draft, name)

    def succeed(self, messages: list[Written | None]) -> None:
        self.enter(SUCCEEDED, [m for m in messages if m is not None], None)

    def fail(self, error: str) -> None:
        self.enter(FAILED, [], error)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.batch = _Batch(options, options["batch_id"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.batch.rows(iterator)

    def commit(self, messages: list) -> None:
        self.batch.succeed(messages)

    def abort(self, messages: list) -> None:
        self.batch.fail("a task failed")


class StreamWriter(DataSourceStreamArrowWriter):
    """Batches of a stream: their numbers repeat after a restart, and so do the ledger's names."""

    def __init__(self, options: dict):
        self.options = options

    def _named(self, number: int) -> _Batch:
        return _Batch(self.options, f"{self.options.get('batch_id', 'batch')}-{number:012d}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _Batch(self.options, "of a stream").rows(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self._named(batchId).succeed(messages)

    def abort(self, messages: list, batchId: int) -> None:
        self._named(batchId).fail("a task failed")


class BatchLedger(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("a ledger only grows: use mode append")
        return BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BatchLedger)


def write(rows: DataFrame, path: str, batch_id: str, source: str, started_at: str | None = None) -> None:
    """Write a batch; if a row has an error or a task failed, leave a failed row in the ledger that says why, and raise."""
    register(rows.sparkSession)
    options = {"path": path, "batch_id": batch_id, "source": source} | ({"started_at": started_at} if started_at else {})
    try:
        rows.write.format(FORMAT).options(**options).mode("append").save()
    except Exception as failed:
        said = re.search(r"rejected: ([^\n]*)", str(failed))
        record_failure(path, batch_id, source, said[1] if said else str(failed).split("\n")[0][:500], started_at)
        raise


def append(rows: DataFrame, path: str, batch_id: str, source: str, started_at: str | None = None) -> bool:
    """``write``, but False where it raises: the ledger has the batch as failed."""
    try:
        write(rows, path, batch_id, source, started_at)
    except PySparkException:
        return False
    return True


def record_failure(path: str, batch_id: str, source: str, error: str, started_at: str | None = None) -> None:
    """A batch whose rows could not even be fetched: failed, with no records."""
    _Batch({"path": path, "source": source, "started_at": started_at}, batch_id).fail(error)


def exists(path: str) -> bool:
    """Whether any batch was ever tried."""
    system, folder = filesystem(f"{path.rstrip('/')}/ledger")
    return bool(system.get_file_info(folder).type)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batch that was ever tried."""
    return spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{path.rstrip('/')}/ledger")


def rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all succeeded batches, with batch_id. Files of other attempts are pruned by the join."""
    system, folder = filesystem(f"{path.rstrip('/')}/data")
    if not exists(path) or not system.get_file_info(folder).type:  # no batch has had a row
        return spark.createDataFrame([], f"{schema}, batch_id string")
    data = spark.read.schema(f"{schema}, attempt string").option("basePath", f"{path.rstrip('/')}/data").parquet(f"{path.rstrip('/')}/data")
    good = batches(spark, path).filter(F.col("status") == SUCCEEDED).select("batch_id", F.explode("attempts").alias("attempt"))
    return data.join(good, "attempt").drop("attempt")
