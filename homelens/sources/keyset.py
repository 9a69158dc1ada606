"""A stream over a Parquet table by the pair (created, id): each batch is the next ``rows`` rows after the last pair.

The offset is the pair itself, so rows with one time are told apart by id, and a row is neither lost nor read twice over restarts.
Batches are planned from the files' statistics: only row groups whose times reach past the offset are opened, and
only those that can hold one of the next ``rows`` pairs; a batch's tasks read the row groups that overlap it. Where a page ends is found by
counting pairs in ranges of times, then of ids, until few are left to be sorted, so the driver's memory does not follow the page. The pair that was handed out last is also kept in the file ``mark`` before Spark hears of it, since Spark does not tell
a restarted source where it stood.

Options: ``path``; ``created`` and ``id``, a time (or whole number) and a whole number; ``rows``; ``mark``; ``lag`` seconds that rows must be old, for
writers whose times arrive out of order. Rows that arrive with a pair below the mark are not seen: that is what a keyset is.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from homelens.sources.ledger import filesystem

FORMAT = "keyset"
LEAST, MOST = -(2**63), 2**63 - 1
FIRST = {"created": LEAST, "id": LEAST}
HELD, AT_ONCE, RANGES = 1 << 20, 1 << 18, 1 << 16


@dataclass
class Group(InputPartition):
    file: str
    group: int
    start: tuple[int, int]
    end: tuple[int, int]


def _micros(column: pa.ChunkedArray) -> pa.ChunkedArray:
    kind = column.type
    return column.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()) if pa.types.is_timestamp(kind) else column.cast(pa.int64())


def _number(value) -> int:
    return value if isinstance(value, int) else _micros(pa.chunked_array([pa.array([value])]))[0].as_py()


def _pair(offset: dict) -> tuple[int, int]:
    return offset["created"], offset["id"]


class KeysetStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.options, self.columns = options, schema.names
        self.most = int(options.get("rows", 10_000))
        self.lag = float(options.get("lag", 0))
        self.known: dict[str, list[tuple[int, int, int, int, int]]] = {}
        self.last: dict | None = None

    def _files(self) -> Iterator[str]:
        from pyarrow import fs

        system, folder = filesystem(self.options["path"])
        found = system.get_file_info(fs.FileSelector(folder, recursive=True)) if system.get_file_info(folder).type == fs.FileType.Directory else [system.get_file_info(folder)]
        return (f.path for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))

    def _open(self, file: str):
        import pyarrow.parquet as pq

        return pq.ParquetFile(filesystem(self.options["path"])[0].open_input_file(file))

    def _groups(self) -> list[tuple[int, int, str, int, int, int]]:
        """(least time, greatest time, file, row group, rows, rows known to have a pair) of all row groups, from their statistics; a
        file's footer is read once."""
        for file in self._files():
            if file not in self.known:
                found = []
                with self._open(file) as opened:
                    at, number = (opened.schema_arrow.names.index(self.options[c]) for c in ("created", "id"))
                    for k in range(opened.num_row_groups):
                        group = opened.metadata.row_group(k)
                        some, other = group.column(at).statistics, group.column(number).statistics
                        counted = all(x is not None and x.has_null_count for x in (some, other))
                        sure = max(0, group.num_rows - some.null_count - other.null_count) if counted else 0
                        ends = (LEAST, MOST) if some is None or not some.has_min_max else (_number(some.min), _number(some.max))
                        found.append((*ends, k, group.num_rows, sure))
                self.known[file] = found
        return sorted((low, high, file, k, rows, sure) for file, groups in self.known.items() for low, high, k, rows, sure in groups)

    def _keys(self, file: str, group: int, start: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Times and ids of the rows after ``start``, some at once."""
        created, number = self.options["created"], self.options["id"]
        with self._open(file) as opened:
            for batch in opened.iter_batches(AT_ONCE, row_groups=[group], columns=list(dict.fromkeys([created, number]))):
                table = self._within(pa.Table.from_batches([batch]), start, (MOST, MOST))
                yield _micros(table.column(created)).to_numpy(), table.column(number).cast(pa.int64()).to_numpy()

    def _between(self, groups: list[tuple], start: tuple[int, int], end: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low, high, file, k, *_ in groups:
            if low <= end[0] and high >= start[0]:
                for at, number in self._keys(file, k, start):
                    some = (at < end[0]) | ((at == end[0]) & (number <= end[1]))
                    yield at[some], number[some]

    def _page_end(self, start: tuple[int, int], newest: int) -> tuple[int, int] | None:
        """The last of the next ``rows`` pairs after ``start`` with times up to ``newest``; None if there is none."""
        groups = [g for g in self._groups() if g[1] >= start[0] and g[0] <= newest]
        if not groups:
            return None
        reach, sure = max(g[1] for g in groups), 0
        for high, rows in sorted((g[1], g[5]) for g in groups if g[0] > start[0] and g[1] <= newest):
            sure += rows
            if sure >= self.most:
                reach = high  # the page ends here at the latest
                break
        least, end, wanted = min(g[0] for g in groups), (min(reach, newest), MOST), self.most
        size = sum(g[4] for g in groups if g[0] <= end[0])
        while size > HELD:
            low, high, by = max(least, start[0] + (start[1] == MOST)), end[0], 0
            if low >= high:  # one time is left
                low, high, by = start[1] + 1 if start[0] == end[0] else LEAST, end[1], 1
                if low >= high:
                    return end  # one pair is left
            width = -(-(high - low + 1) // RANGES)
            counts = np.zeros(RANGES, np.int64)
            for keys in self._between(groups, start, end):
                counts += np.bincount(((keys[by].view(np.uint64) - np.uint64(low % 2**64)) // np.uint64(width)).astype(np.int64), minlength=RANGES)
            upto = np.cumsum(counts)
            if not upto[-1]:
                return None
            wanted = min(wanted, int(upto[-1]))
            k = int(np.searchsorted(upto, wanted))
            size, wanted = int(counts[k]), wanted - int(upto[k] - counts[k])
            first, last = low + k * width, min(high, low + (k + 1) * width - 1)
            if k:
                start = (end[0], first - 1) if by else (first - 1, MOST)
            end = (end[0], last) if by else min(end, (last, MOST))
        found = list(self._between(groups, start, end))
        at, number = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        if not len(at):
            return None
        last = np.lexsort((number, at))[min(wanted, len(at)) - 1]
        return int(at[last]), int(number[last])

    def _within(self, table: pa.Table, start: tuple[int, int], end: tuple[int, int]) -> pa.Table:
        at, number = _micros(table.column(self.options["created"])), table.column(self.options["id"]).cast(pa.int64())
        after = pc.or_(pc.greater(at, start[0]), pc.and_(pc.equal(at, start[0]), pc.greater(number, start[1])))
        upto = pc.or_(pc.less(at, end[0]), pc.and_(pc.equal(at, end[0]), pc.less_equal(number, end[1])))
        return table.filter(pc.and_(after, upto))

    def initialOffset(self) -> dict:
        return FIRST

    def _marked(self) -> dict:
        system, mark = filesystem(self.options["mark"])
        if not system.get_file_info(mark).is_file:
            return FIRST
        with system.open_input_stream(mark) as there:
            return json.loads(there.read())

    def latestOffset(self) -> dict:
        last = self.last or self._marked()
        end = self._page_end(_pair(last), int((time.time() - self.lag) * 1e6) if self.lag else MOST)
        if end:
            last = {"created": end[0], "id": end[1]}
            system, mark = filesystem(self.options["mark"])
            draft = f"{mark}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(json.dumps(last).encode())
            system.move(draft, mark)
        self.last = last
        return last

    def partitions(self, start: dict, end: dict) -> list[Group]:
        a, b = _pair(start), _pair(end)
        return [Group(file, k, a, b) for low, high, file, k, *_ in self._groups() if low <= b[0] and high >= a[0]] if a < b else []

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        with self._open(partition.file) as opened:
            names = list(dict.fromkeys([*self.columns, self.options["created"], self.options["id"]]))
            table = opened.read_row_group(partition.group, names)
        yield from self._within(table, partition.start, partition.end).select(self.columns).to_batches()


class Keyset(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema) -> KeysetStream:
        return KeysetStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Keyset)
