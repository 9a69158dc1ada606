"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

Every suffix starts in the bucket of its q-gram, 8 bytes, whose mixed code is the bucket's identifier. A bucket
is refined by the identifiers at later offsets: the identifier of depth 2h at a place is made of those of
depth h there and h bytes on, and each round takes up what the round before has made (``_Buckets``).
Equality is all that is asked for, so an identifier is a 64-bit name, the same in every task, in place of a
rank that only a global sort could give. Identifiers are drawn in two lanes, each from q-grams mixed with a number of
its own that the driver draws for each run: buckets are named in one lane and whole windows in the other, so a match rests on
two independent names (96 bits), and nobody can write texts whose names agree, since the numbers are not known before.

Buckets are sorted across tasks only where a match can begin. Each window of ``window`` bytes owns the
leftmost smallest 64-byte bucket in it, so equal windows own equal buckets at equal offsets. The buckets of
these places meet by ranges of identifiers, and a range sorts its buckets on the identifiers, at full depth,
of the first and the last window that the place owns. A bucket with one place is done: none of its
windows occurs again. Places that agree on both identifiers share all their windows. The rest stays open,
and is refined once more by the full-depth identifiers of each of its windows; where a bucket has several
contexts, one holder of each shared context takes part for all of them.

Documents are packed into blocks and written once, so that all steps see the same blocks whatever is run again. Tasks
send each distinct name once per block of documents, in packed arrays by range, and get one code
back for each; a passage in every document costs one name a block. Blocks and ranges follow from the
size of the corpus.

Defined results: null text is empty, texts shorter than the window lose nothing, matches never cross
documents; repeated rows lose all they share; an empty table gives no rows; other columns are ignored. A text
of any length is worked on in pieces of ``piece`` bytes. The window must be longer than 64 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from homelens.llm import blocks, bytesets
from homelens.llm.sizing import text_bytes

GRAM = 64
PIECE = 1 << 19
BLOCK = 4 << 20
RANGE = 48 << 20
U = np.uint64
LATER, STIR = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
UNIQUE, SHARED, SEVERAL = 0, 1, 2
SETTLED, OPEN, HOLDER = 0, 1, 2
SENT = "shard int, block long, names binary, checks binary, many binary"
CODES = "shard int, block long, codes binary"
PLACES = "block long, at binary, back binary, gram binary, context binary"
STATES = "block long, at binary, back binary, gram binary, state binary"


def _pair(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of buckets from those at a place and at a later offset."""
    out = later * LATER
    out ^= here
    out ^= out >> U(32)
    out *= STIR
    out ^= out >> U(29)
    return out


class _Buckets:
    """Bucket identifiers, in one lane, of all suffixes of a byte array: the q-gram's 8 bytes, then depths 16, 32 and 64."""

    def __init__(self, data: np.ndarray, lane: int) -> None:
        data = np.ascontiguousarray(data)
        names = bytesets.mix(np.ndarray((max(0, len(data) - 7),), "<u8", data.tobytes(), strides=(1,)) ^ U(lane))
        depth = 8
        while depth < GRAM:
            names = _pair(names[:-depth], names[depth:]) if len(names) > depth else names[:0]
            depth *= 2
        self.names = names

    def at(self, places: np.ndarray, depth: int) -> np.ndarray:
        """Identifiers of some suffixes at a depth of ``GRAM`` or more, from those of half the depth."""
        if depth == GRAM:
            return self.names[places]
        half = GRAM
        while 2 * half < depth:
            half *= 2
        return _pair(self.at(places, half), self.at(places + depth - half, half))


def _owners(names: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost smallest of ``span`` names from each start on: a sliding minimum of name and place in one number."""
    bits = U(24)
    keys = (names >> bits << bits) | np.arange(len(names), dtype=U)
    rows = -(-len(keys) // span)
    grid = np.full(rows * span, np.iinfo(U).max, U)
    grid[: len(keys)] = keys
    grid = grid.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[starts], ahead[starts + span - 1]) & ((U(1) << bits) - U(1))).astype(np.int64)


def _whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, all bytes, offsets) of a block."""
    ids, sizes, raw = blocks.opened(table)
    return ids, np.frombuffer(raw, np.uint8), np.cumsum(np.append(0, sizes))


def _windows_out(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Places as steps, and how far back their first and last windows start."""
    return [np.diff(at, prepend=0).astype("<u4").tobytes(), np.stack([at - first, at - last]).astype("<u2").tobytes()]


def _windows_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.cumsum(_array(table, "at", np.uint32), dtype=np.int64)
    back = _array(table, "back", np.uint16).reshape(2, -1)
    return at, at - back[0], at - back[1]


def _cuts(offsets: np.ndarray, window: int, piece: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, first starts, number of starts of each document) of pieces of about ``piece`` bytes; long documents are cut."""
    runs = []
    for a, n in zip(offsets[:-1].tolist(), (np.diff(offsets) - window + 1).tolist(), strict=True):
        runs += [(a + k, min(piece, n - k)) for k in range(0, n, piece)] if n > 0 else []
    i = 0
    while i < len(runs):
        j = i + 1
        while j < len(runs) and runs[j][0] + runs[j][1] + window - 1 - runs[i][0] <= piece + window:
            j += 1
        first = runs[i][0]
        yield first, np.array([r[0] - first for r in runs[i:j]]), np.array([r[1] for r in runs[i:j]])
        i = j


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 .. for each of the runs."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)


def _places(data: np.ndarray, offsets: np.ndarray, window: int, lanes: tuple[int, int], piece: int = PIECE) -> list[np.ndarray]:
    """[place, first and last window that owns it, 64-byte bucket, context] of all places that windows own."""
    found = []
    for begin, first, count in _cuts(offsets, window, piece):
        starts = _runs(first, count)
        some = data[begin : begin + int(starts[-1]) + window]
        buckets, strings = _Buckets(some, lanes[0]), _Buckets(some, lanes[1])
        owner = _owners(buckets.names, starts, window - GRAM + 1)
        new = np.ones(len(starts), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        at, low, high = owner[head], starts[head], starts[np.append(head[1:], len(starts)) - 1]
        offset = (at - low).astype(U) << U(32) | (at - high).astype(U)
        context = _pair(_pair(strings.at(low, window), strings.at(high, window)), offset)
        found.append((at + begin, low + begin, high + begin, bytesets.mix(buckets.at(at, GRAM)), context))  # mixed: the least names are no even ranges
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, t) for t in (np.int64, np.int64, np.int64, U, U)]


def _packed(block: int, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], bits: int) -> pa.Table:
    """One row for each range of (base, names in ascending order, checks, many)."""
    rows = []
    for base, names, checks, many in parts:
        of, first = np.unique(names >> U(64 - bits), return_index=True)
        for k, i, j in zip(of.tolist(), first.tolist(), [*first[1:].tolist(), len(names)][: len(of)], strict=True):
            rows.append((base + k, block, names[i:j].tobytes(), checks[i:j].tobytes(), many[i:j].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "names", "checks", "many"])


def _distinct(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct names, first half of each one's bucket name, whether it occurs twice): a match of strings rests on 96 bits."""
    names, first, count = np.unique(names, return_index=True, return_counts=True)
    return names, (checks[first] >> U(32)).astype(np.uint32), (count > 1).astype(np.uint8)


def _array(table: pa.Table, column: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


def _meet(table: pa.Table, ranges: int) -> pa.Table:
    """A code for each name that a block sent. Ranges below ``ranges`` hold 64-byte buckets with the one context they
    have in a block (0: several); ranges above hold strings with their bucket, and give the first block that holds a shared one another code."""
    table = table.sort_by("block")
    shard = table.column("shard")[0].as_py()
    names, checks, many = _array(table, "names", U), _array(table, "checks", U if shard < ranges else np.uint32), _array(table, "many", np.uint8)
    each = np.array([len(x) // 8 for x in table.column("names").to_pylist()])
    if shard < ranges:
        order = np.argsort(names, kind="stable")
        new = np.ones(len(names), bool)
        new[1:] = names[order][1:] != names[order][:-1]
    else:
        order = np.lexsort((checks, names))
        new = np.ones(len(names), bool)
        new[1:] = (names[order][1:] != names[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    head = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    shared = (np.diff(np.append(head, len(names))) > 1) | (np.maximum.reduceat(many[order], head) > 0)
    codes = np.empty(len(names), np.uint8)
    if shard < ranges:
        low, high = np.minimum.reduceat(checks[order], head), np.maximum.reduceat(checks[order], head)
        codes[order] = np.where(shared, np.where((low == high) & (low > 0), SHARED, SEVERAL), UNIQUE)[run]
    else:
        codes[order] = np.where(shared[run], np.where(new, SEVERAL, SHARED), UNIQUE)
    cuts = np.append(0, np.cumsum(each))
    return pa.table([table.column("shard"), table.column("block"), pa.array([codes[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["shard", "block", "codes"])


def _codes(table: pa.Table) -> np.ndarray:
    return _array(table.sort_by("shard"), "codes", np.uint8)


def _states(places: pa.Table, answers: pa.Table) -> pa.Table:
    """Places whose bucket others share, with their state; see ``_meet``."""
    at, first, last = _windows_in(places)
    gram, context = _array(places, "gram", U), _array(places, "context", U)
    codes = _codes(answers)
    grams, of_gram = np.unique(gram, return_inverse=True)
    _, lead, of_context = np.unique(context, return_index=True, return_inverse=True)
    bucket, string = codes[: len(grams)][of_gram], codes[len(grams) :][of_context]
    leads = np.zeros(len(at), bool)
    leads[lead] = True
    state = np.where((bucket == SHARED) | (string == SHARED) | ((string == SEVERAL) & ~leads), SETTLED, np.where(string == SEVERAL, HOLDER, OPEN)).astype(np.uint8)
    keep = np.flatnonzero(bucket != UNIQUE)
    kept = [*_windows_out(at[keep], first[keep], last[keep]), gram[keep].tobytes(), state[keep].tobytes()]
    return pa.table([pa.array([places.column("block")[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in kept)], names=["block", "at", "back", "gram", "state"])


def _open_windows(data: np.ndarray, states: pa.Table, window: int, lane: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, identifiers at full depth, buckets) of the windows that are open or stand for a shared context."""
    _, first, last = _windows_in(states)
    gram, asks = _array(states, "gram", U), _array(states, "state", np.uint8) != SETTLED
    first, last, gram = first[asks], last[asks], gram[asks]
    size = np.cumsum(last - first + window)
    found = []
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + piece, "right")))
        low, high = first[i:j], last[i:j]
        new = np.ones(j - i, bool)
        new[1:] = low[1:] > high[:-1] + window
        head = np.flatnonzero(new)
        begin, stop = low[head], high[np.append(head[1:], j - i) - 1] + window
        moved = np.cumsum(stop - begin) - (stop - begin) - begin
        starts = _runs(low, high - low + 1)
        strings = _Buckets(data[_runs(begin, stop - begin)], lane)
        group = np.repeat(np.cumsum(new) - 1, high - low + 1)
        found.append((starts, strings.at(starts + moved[group], window), np.repeat(gram[i:j], high - low + 1)))
        i = j
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, U), np.empty(0, U))


def remove_repeats(docs: DataFrame, window: int = 200, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): each text without the bytes of any
    ``window``-byte string that starts anywhere else as well."""
    total = text_bytes(docs)
    bits = max(6, (total // RANGE).bit_length())
    ranges = 1 << bits
    lanes = tuple(int(x) for x in np.random.default_rng().integers(0, 2**63, 2))
    by_block = blocks.pack(docs, int(min(16 * BLOCK, max(BLOCK, 64 * total**0.5))), "repeat-blocks").groupBy("block")

    def places(table: pa.Table) -> pa.Table:
        _, data, offsets = _whole(table)
        *windows, gram, context = _places(data, offsets, window, lanes, piece)
        found = [*_windows_out(*windows), gram.tobytes(), context.tobytes()]
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in found)], names=["block", "at", "back", "gram", "context"])

    def send(table: pa.Table) -> pa.Table:
        gram, context = _array(table, "gram", U), _array(table, "context", U)
        order = np.lexsort((context, gram))
        sorted_gram, sorted_context = gram[order], context[order]
        head = np.flatnonzero(np.append(True, sorted_gram[1:] != sorted_gram[:-1])) if len(gram) else np.empty(0, np.int64)
        tail = np.append(head[1:], len(gram)) - 1 if len(gram) else head
        only = np.where(sorted_context[head] == sorted_context[tail], sorted_context[head] | U(1), U(0))
        grams = (0, sorted_gram[head], only, (tail > head).astype(np.uint8))
        return _packed(table.column("block")[0].as_py(), [grams, (ranges, *_distinct(context, gram))], bits)

    def ask(table: pa.Table, states: pa.Table) -> pa.Table:
        if not table.num_rows or not states.num_rows:
            return _packed(0, [], bits)
        _, data, _ = _whole(table)
        _, names, grams = _open_windows(data, states, window, lanes[1], piece)
        return _packed(table.column("block")[0].as_py(), [(ranges, *_distinct(names, grams))], bits)

    def answer(states: pa.Table, answers: pa.Table) -> pa.Table:
        return states.append_column("codes", pa.array([_codes(answers).tobytes() if answers.num_rows else b""] * states.num_rows, pa.binary()))

    def cut(table: pa.Table, states: pa.Table) -> pa.Table:
        ids, data, offsets = _whole(table)
        starts = np.empty(0, np.int64)
        if states.num_rows:
            _, first, last = _windows_in(states)
            done = _array(states, "state", np.uint8) != OPEN
            asked, names, _ = _open_windows(data, states, window, lanes[1], piece)
            again = _array(states, "codes", np.uint8)[np.unique(names, return_inverse=True)[1]] > 0
            starts = np.union1d(_runs(first[done], last[done] - first[done] + 1), asked[again])
        doc = np.searchsorted(offsets, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] > starts[:-1] + window) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        low, high = starts[head], starts[np.append(head[1:], len(starts)) - 1] + window if len(starts) else starts
        bound = np.searchsorted(doc[head], np.arange(len(offsets)))
        removed = np.diff(np.append(0, np.cumsum(high - low))[bound])
        kept = []
        raw = memoryview(data) if len(data) else memoryview(b"")
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            i, j = bound[k], bound[k + 1]
            left = zip([a, *high[i:j].tolist()], [*low[i:j].tolist(), b], strict=True)
            kept.append(b"".join(raw[x:y] for x, y in left))
        digest = [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table(
            [pa.array(ids, pa.int64(), mask=ids == blocks.LAST), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(bound)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    def meet(sent: DataFrame):
        return sent.groupBy("shard").applyInArrow(lambda table: _meet(table, ranges), CODES).groupBy("block")

    owned = by_block.applyInArrow(places, PLACES).groupBy("block")
    states = owned.cogroup(meet(owned.applyInArrow(send, SENT))).applyInArrow(_states, STATES).groupBy("block")
    answers = meet(by_block.cogroup(states).applyInArrow(ask, SENT))
    judged = states.cogroup(answers).applyInArrow(answer, STATES + ", codes binary").groupBy("block")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return by_block.cogroup(judged).applyInArrow(cut, result)


def op2_bucket_refinement(spark, sf_dir: str) -> DataFrame:
    """What removal of repeated 200-byte strings leaves of every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
