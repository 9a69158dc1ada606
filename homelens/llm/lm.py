"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from memory-mapped arrays.

Words are one sorted array of 64-bit hashes, in shards by hash range; the rank of a hash is the word's id.
An n-gram of order k is the pair of the ids of its first and its last k - 1 words, so every order is counted
by the same two jobs from the ids of the order below, and its place among all of its order is its own id.
Shards hold sorted first parts, offsets, sorted last parts and counts; first parts that hold over 1/512 of all
tokens are spread by n-gram. How many different words come before an n-gram (its continuation count) and the
sums over a first part's n-grams are arrays by id. Counts take one byte, with a list of larger ones. A shard's arrays of
one kind are one file, written by the task that reduced it, straight into the shared folder, and mapped by a worker when
it first needs the shard; the driver sees counts of counts, file sizes and at most 512 frequent ids an order. The number of shards
follows from the bytes of the texts.

Tokens are lower-cased (A-Z) words and one end a text; one begin comes before each text and is never predicted.
P(w | v) = (max(c(v w) - D(c), 0) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) P(w | v')) / c(v), where v' lacks v's first
word; c are counts at the highest order and for n-grams at the begin of a text, continuation counts
elsewhere. The lowest order's rest is spread evenly over the vocabulary and one unknown word. After an unknown
context the shorter one's chance holds.

Defined results: null, empty and blank text is one end; repeated rows count each; without training documents all
scores are 0; an empty table gives no rows; other columns are ignored. Ids take 64 bits where 32 are too few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homelens.llm import bytesets, storage
from homelens.llm.langid import held_out
from homelens.llm.sizing import text_bytes

ORDER = 3
SHARD_BYTES = 16 << 20
HOT = 512
HELD = 4_000_000
PACKED_AT_ONCE = 1_000_000
SENT = 250_000
U = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKED = "shard int, a binary, b binary, c binary"
SMALL = ("u1", "<u8", "<i8")


def _planes(x: np.ndarray, ascending: bool) -> bytes:
    """Whole numbers byte plane by byte plane, ascending ones as steps, so that the shuffle's compression finds the zeros."""
    x = np.diff(x.astype(U), prepend=U(0)) if ascending else x.astype("<u8")
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(table: pa.Table, column: str, ascending: bool) -> np.ndarray:
    """All rows' numbers of a column written by ``_planes``."""
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel() for b in table.column(column).to_pylist()]
    return np.concatenate([np.cumsum(p, dtype=U) if ascending else p for p in parts]) if parts else np.empty(0, U)


def _by_shard(shard: np.ndarray, count: int) -> np.ndarray:
    """Stable order by shard; few shards are sorted by their 16 bits."""
    return np.argsort(shard.astype(np.uint16) if count <= 1 << 16 else shard, kind="stable")


def _pack(shard: np.ndarray, arrays: list[np.ndarray], count: int) -> Iterator[pa.RecordBatch]:
    """One row a shard that occurs, in batches of about ``SENT`` numbers; the first array ascends within each shard."""
    order = _by_shard(shard, count)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=count))])
    some = np.flatnonzero(np.diff(cuts))
    for few in np.split(some, _starts(cuts[some] // SENT)[1:]) if len(some) else []:
        at = [order[cuts[s] : cuts[s + 1]] for s in few]
        parts = [pa.array([_planes(x[places], k == 0) for places in at], pa.binary()) for k, x in enumerate(arrays)]
        parts += [pa.array([b""] * len(few), pa.binary())] * (3 - len(parts))
        yield pa.RecordBatch.from_arrays([pa.array(few, pa.int32()), *parts], names=["shard", "a", "b", "c"])


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a.astype(U)
    out <<= U(32)
    out |= b.astype(U)
    return out


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) and max(int(a.max()), int(b.max())) >> 32:
        return np.lexsort((b, a))
    return np.argsort(_joint(a, b))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal sorted keys starts."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    np.not_equal(keys[0][1:], keys[0][:-1], out=new[1:])
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, the place of each value among them)."""
    order = np.argsort(x)
    x = x[order]
    first = _starts(x)
    where = np.empty(len(x), np.int64)
    where[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    return x[first], where


def _sum_by(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    order = np.lexsort(keys[::-1]) if len(keys) == 2 else np.argsort(keys[0], kind="stable")  # takes sorted runs as they are
    keys, counts = tuple(k[order] for k in keys), counts[order]
    first = _starts(*keys)
    return tuple(k[first] for k in keys), np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts


def _counted(keys: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys of a piece and how often each occurs."""
    if len(keys) == 2:
        return _sum_by(keys, np.ones(len(keys[0]), np.int64))
    key = np.sort(keys[0])
    first = _starts(key)
    counts = np.diff(np.append(first, len(key)))
    return (key[first],), counts.astype(np.uint32) if len(key) < 2**32 else counts


def _gathered(batches: Iterator[pa.RecordBatch], take: Callable, give: Callable) -> Iterator[pa.RecordBatch]:
    """Keys of all pieces, counted, given on whenever ``HELD`` are held; what is held is freed before it is packed."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([c for _, c in held])
        keys = tuple(np.concatenate(k) for k in zip(*(k for k, _ in held), strict=True))
        held.clear()
        keys, counts = _sum_by(keys, counts)
        for low in range(0, len(counts), PACKED_AT_ONCE):
            some = slice(low, low + PACKED_AT_ONCE)
            yield from give(tuple(k[some] for k in keys), counts[some])

    for batch in batches:
        for _, data, offsets in bytesets.pieces(batch, "text"):
            held.append(_counted(take(data, offsets)))
            size += len(held[-1][1])
            if size > HELD:
                yield from flush()
                size = 0
    if size:
        yield from flush()


def _small(values: np.ndarray) -> list[np.ndarray]:
    """Counts of one byte each and a list of those of 255 and more."""
    large = np.flatnonzero(values >= 255)
    return [np.minimum(values, 255).astype("u1"), large.astype("<u8"), values[large].astype("<i8")]


class _Small:
    def __init__(self, low: np.ndarray, at: np.ndarray, large: np.ndarray) -> None:
        self.low, self.at, self.large = low, at, large

    def get(self, places: np.ndarray) -> np.ndarray:
        out = self.low[places].astype(np.int64)
        if len(self.at) and len(big := np.flatnonzero(out == 255)):
            out[big] = self.large[np.searchsorted(self.at, places[big].astype(U))]
        return out


class _ById:
    """Rows of small counts by id, cut into ranges of ids; ids below 0 and ranges without a file have zeros."""

    def __init__(self, path: str, rows: int, width: int, ids: int, present: frozenset[int]) -> None:
        self.path, self.rows, self.width, self.ids, self.present = path, rows, width, ids, present

    def _range(self, r: int) -> list[_Small]:
        arrays = storage.map_arrays(f"{self.path}-{r}", SMALL * self.rows) if r in self.present else []
        return [_Small(*arrays[k : k + 3]) for k in range(0, len(arrays), 3)]

    def get(self, ids: np.ndarray) -> np.ndarray:
        known = np.flatnonzero(ids >= 0)
        parts = ids[known] // self.width
        order = _by_shard(parts, -(-self.ids // self.width))
        known, parts = known[order], parts[order]
        places = ids[known] - parts * self.width
        found = np.zeros((self.rows, len(known)), np.int64)
        ends = np.append(_starts(parts), len(parts))
        for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
            for k, small in enumerate(self._range(int(parts[low]))):
                found[k, low:high] = small.get(places[low:high])
        out = np.zeros((self.rows, len(ids)), np.int64)
        for k in range(self.rows):
            out[k, known] = found[k]
        return out


class Vocabulary:
    """Ids and counts of words."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int]) -> None:
        self.folder, self.bits, self.sizes = folder, bits, sizes
        self.offset = _offsets(sizes)
        self.size = sum(sizes.values())

    def find(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of ascending hashes."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        parts = sorted_hashes >> U(64 - self.bits)
        for low in _starts(parts).tolist():
            s, high = int(parts[low]), int(np.searchsorted(parts, parts[low], "right"))
            if self.sizes.get(s):
                known, *counted = storage.map_arrays(f"{self.folder}/words-{s}", ("<u8", *SMALL))
                some = sorted_hashes[low:high]
                at = np.minimum(np.searchsorted(known, some), len(known) - 1)
                hit = known[at] == some
                ids[low:high] = np.where(hit, at + self.offset[s], -1)
                counts[low:high] = np.where(hit, _Small(*counted).get(at), 0)
        return ids, counts


def _offsets(sizes: dict[int, int]) -> dict[int, int]:
    out, total = {}, 0
    for s in sorted(sizes):
        out[s] = total
        total += sizes[s]
    return out


def _id_type(ids: int) -> str:
    return "<u4" if ids < 2**32 else "<u8"


def _gram_shard(first: np.ndarray, last: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    spread = bytesets.mix(first.astype(U))
    if len(hot):
        many = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, first), len(hot) - 1)] == first)
        spread[many] = bytesets.mix(spread[many] ^ last[many].astype(U))
    return (spread >> U(64 - bits)).astype(np.int64)


class Grams:
    """Ids and counts of n-grams of one order, from the ids of their first and last parts."""

    def __init__(self, folder: str, order: int, bits: int, sizes: dict[int, int], below: int, hot: np.ndarray) -> None:
        self.path, self.bits, self.sizes, self.kind, self.hot, self.offset = f"{folder}/grams{order}", bits, sizes, _id_type(below), hot, _offsets(sizes)

    def shard(self, s: int) -> tuple[list[np.ndarray], _Small]:
        """(first parts, ends, last parts) and counts."""
        arrays = storage.map_arrays(f"{self.path}-{s}", (self.kind, _id_type(self.sizes[s]), self.kind, *SMALL))
        return arrays[:3], _Small(*arrays[3:])

    @staticmethod
    def _place(lasts: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first place from ``low`` whose number is not less than ``wanted``, ``high`` at most; ranges that are done are dropped."""
        out, live = low.copy(), np.flatnonzero(low < high)
        low, high, wanted = low[live], high[live], wanted[live]
        while len(live):
            mid = (low + high) >> 1
            less = lasts[mid] < wanted
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            more = low < high
            if not more.all():
                out[live[~more]] = low[~more]
                live, low, high, wanted = live[more], low[more], high[more], wanted[more]
        return out

    def find(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of pairs in any order; a part below 0 is unknown."""
        ids, counts = np.full(len(first), -1, np.int64), np.zeros(len(first), np.int64)
        known = np.flatnonzero((first >= 0) & (last >= 0))
        shard = _gram_shard(first[known], last[known], self.hot, self.bits)
        order = _by_shard(shard, 1 << self.bits)
        known, shard = known[order], shard[order]
        for start in _starts(shard).tolist():
            s, stop = int(shard[start]), int(np.searchsorted(shard, shard[start], "right"))
            if not self.sizes.get(s):
                continue
            (firsts, ends, lasts), small = self.shard(s)
            mine = known[start:stop]
            at = np.minimum(np.searchsorted(firsts, first[mine].astype(firsts.dtype)), len(firsts) - 1)
            there = firsts[at] == first[mine]
            mine, at = mine[there], at[there]
            low, high, wanted = np.where(at > 0, ends[at - 1], 0).astype(np.int64), ends[at].astype(np.int64), last[mine].astype(lasts.dtype)
            place = self._place(lasts, low, high - 1, wanted)
            hit = lasts[place] == wanted
            mine, place = mine[hit], place[hit]
            ids[mine], counts[mine] = place + self.offset[s], small.get(place)
        return ids, counts


def _discounts(n: list[int]) -> list[float]:
    """Discounts for counts 1, 2 and more from the numbers of n-grams seen one to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(raw, 1))]


def _counts_of_counts(values: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5].astype("<i8")


class Model:
    """File sizes and the few numbers that hold for all; opens the files where they are used."""

    def __init__(self, folder: str, bits: int, order: int, words: dict[int, int], tokens: int, docs: int) -> None:
        self.folder, self.bits, self.order, self.words, self.tokens, self.docs = folder, bits, order, words, tokens, docs
        self.vocabulary_size = sum(words.values())
        self.distinct = self.vocabulary_size + (docs > 0)
        self.sizes: dict[int, dict[int, int]] = {}
        self.hot: dict[int, np.ndarray] = {}
        self.follows: dict[int, frozenset[int]] = {}
        self.sums: dict[int, frozenset[int]] = {}
        self.discounts: dict[int, list[float]] = {}
        self.floor = 0.0

    def ids(self, order: int) -> int:
        """How many ids the n-grams of an order take; words also have the end and the begin."""
        return self.vocabulary_size + 2 if order == 1 else sum(self.sizes[order].values())

    def width(self, order: int) -> int:
        return max(1, -(-self.ids(order) // (1 << self.bits)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _opened(self, name: str, make: Callable) -> object:
        opened = self.__dict__.setdefault("_open", {})
        if name not in opened:
            opened[name] = make()
        return opened[name]

    def vocabulary(self) -> Vocabulary:
        return self._opened("words", lambda: Vocabulary(self.folder, self.bits, self.words))

    def grams(self, order: int) -> Grams:
        return self._opened(f"grams{order}", lambda: Grams(self.folder, order, self.bits, self.sizes[order], self.ids(order - 1), self.hot[order]))

    def preceding(self, order: int, ids: np.ndarray) -> np.ndarray:
        """How many different words come before n-grams of an order below the highest."""
        return self._opened(f"follows{order}", lambda: _ById(f"{self.folder}/follows{order}", 1, self.width(order), self.ids(order), self.follows[order])).get(ids)[0]

    def context(self, order: int, ids: np.ndarray) -> np.ndarray:
        """(sum, ones, twos, more) over the n-grams of an order with these first parts."""
        return self._opened(f"sums{order}", lambda: _ById(f"{self.folder}/sums{order}", 4, self.width(order - 1), self.ids(order - 1), self.sums[order])).get(ids)

    def words_of(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids with an end after each text, counts, the text each belongs to, its place there)."""
        distinct, where = _distinct(words)
        ids, counts = self.vocabulary().find(distinct)
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(n)), n + 1)
        ends = np.cumsum(n + 1) - 1
        out, known = np.full(len(row), self.vocabulary_size if self.docs else -1, np.int64), np.full(len(row), self.docs, np.int64)
        inner = np.ones(len(row), bool)
        inner[ends] = False
        out[inner], known[inner] = ids[where], counts[where]
        return out, known, row, np.arange(len(row)) - (ends - n)[row]

    def parts(self, ids: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(id of the first part or -1, whether there is an n-gram) of every token, from the ids of the order below."""
        first = np.full(len(ids), -1, np.int64)
        first[1:] = ids[:-1]
        if order == 2:
            first[place == 0] = self.vocabulary_size + 1
        there = place >= order - 2
        return np.where(there, first, -1), there

    def above(self, ids: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first parts, ids, counts) of the n-grams of an order that end at each token."""
        first, _ = self.parts(ids, place, order)
        by = _order(first + 1, ids + 1)
        starts = _starts(first[by], ids[by])
        found, counts = self.grams(order).find(first[by[starts]], ids[by[starts]])
        where = np.empty(len(ids), np.int64)
        where[by] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        return first, found[where], counts[where]

    def score(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: number of tokens, known tokens, base score and model score."""
        ids, counts, row, place = self.words_of(words, bounds)
        texts = len(bounds) - 1
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))
        chance = np.full(len(ids), 1.0)
        if self.docs:
            f, d = self.preceding(1, ids), np.array(self.discounts[1])
            chance = np.maximum(f - d[np.minimum(f, 3)], 0) / self.ids(2) + self.floor
            for order in range(2, self.order + 1):
                first, ids, c = self.above(ids, place, order)
                if order < self.order:
                    before = self.preceding(order, ids)
                    c = np.where(before > 0, before, c)
                total, once, twice, more = self.context(order, first)
                d, seen = np.array(self.discounts[order]), total > 0
                mixed = (np.maximum(c - d[np.minimum(c, 3)], 0) + (d[1] * once + d[2] * twice + d[3] * more) * chance) / np.maximum(total, 1)
                chance = np.where(seen, mixed, chance)
        model = np.log10(chance)
        return (np.bincount(row, minlength=texts), np.bincount(row, counts > 0, minlength=texts).astype(np.int64), np.bincount(row, base, minlength=texts), np.bincount(row, model, minlength=texts))


def _note(shard: int, *numbers: np.ndarray | list[int]) -> pa.RecordBatch:
    parts = [pa.array([np.asarray(x, "<i8").tobytes()], pa.binary()) for x in numbers] + [pa.array([b""], pa.binary())] * (3 - len(numbers))
    return pa.RecordBatch.from_arrays([pa.array([-1 - shard], pa.int32()), *parts], names=["shard", "a", "b", "c"])


def _count_words(only: DataFrame, folder: str, bits: int, docs: int, order: int) -> Model:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda keys, counts: _pack((keys[0] >> U(64 - bits)).astype(np.int64), [keys[0], counts], 1 << bits)
        return _gathered(batches, lambda data, offsets: (bytesets.word_hashes(data, offsets)[0],), give)

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        (keys,), counts = _sum_by((_numbers(table, "a", True),), _numbers(table, "b", False).astype(np.int64))
        storage.write_arrays(f"{folder}/words-{shard}", keys, *_small(counts))
        top = np.argsort(-counts, kind="stable")[:HOT]
        return pa.Table.from_batches([_note(shard, [len(keys), counts.sum()], top, counts[top])])

    made = {-1 - r["shard"]: [np.frombuffer(r[k], "<i8") for k in "abc"] for r in only.mapInArrow(words, PACKED).groupBy("shard").applyInArrow(write, PACKED).collect()}
    model = Model(folder, bits, order, {s: int(x[0][0]) for s, x in made.items()}, docs + sum(int(x[0][1]) for x in made.values()), docs)
    at = _offsets(model.words)
    model.hot[2] = np.array([model.vocabulary_size + 1, *sorted(at[s] + int(i) for s, (_, top, times) in made.items() for i, c in zip(top, times, strict=True) if c * HOT > model.tokens)])
    return model


def _count_grams(only: DataFrame, model: Model, order: int) -> list[int]:
    """Write the n-grams of an order and how many of them end in each of the order below; counts of counts of the latter."""
    folder, bits, hot, tokens = model.folder, model.bits, model.hot[order], model.tokens
    below, width = model.ids(order - 1), model.width(order - 1)
    kind = _id_type(below)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, _, _, place = model.words_of(*bytesets.word_hashes(data, offsets))
            for k in range(2, order):
                ids = model.above(ids, place, k)[1]
            first, there = model.parts(ids, place, order)
            return (_joint(first[there], ids[there]),) if below < 2**32 else (first[there], ids[there])

        def give(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            first, last = keys if len(keys) == 2 else ((keys[0] >> U(32)).astype("<u4"), keys[0].astype("<u4"))
            return _pack(_gram_shard(first, last, hot, bits), [first, last, counts], 1 << bits)

        return _gathered(batches, take, give)

    def write_grams(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = (_numbers(table, "a", True).astype(np.int64), _numbers(table, "b", False).astype(np.int64))
        counts = _numbers(table, "c", False).astype(np.int64)
        if below < 2**32:
            (joint,), counts = _sum_by((_joint(*keys),), counts)
            first, last = (joint >> U(32)).astype(np.int64), (joint & U(0xFFFFFFFF)).astype(np.int64)
        else:
            (first, last), counts = _sum_by(keys, counts)
        starts = _starts(first)
        storage.write_arrays(f"{folder}/grams{order}-{shard}", first[starts].astype(kind), np.append(starts[1:], len(first)).astype(_id_type(len(first))), last.astype(kind), *_small(counts))
        follow, times = np.unique(last, return_counts=True)
        frequent = np.flatnonzero(counts * HOT > tokens)
        return pa.Table.from_batches([*_pack(follow // width, [follow, times], 1 << bits), _note(shard, [len(first)], frequent)])

    def write_follows(table: pa.Table) -> pa.Table:
        part = table.column("shard")[0].as_py()
        if part < 0:
            return table
        values = np.zeros(min(width, below - part * width), np.int64)
        np.add.at(values, _numbers(table, "a", True).astype(np.int64) - part * width, _numbers(table, "b", False).astype(np.int64))
        storage.write_arrays(f"{folder}/follows{order - 1}-{part}", *_small(values))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([_counts_of_counts(values).tobytes()], pa.binary())] * 3], names=["shard", "a", "b", "c"])])

    made = only.mapInArrow(grams, PACKED).groupBy("shard").applyInArrow(write_grams, PACKED).groupBy("shard").applyInArrow(write_follows, PACKED).collect()
    notes = {-1 - r["shard"]: (int(np.frombuffer(r["a"], "<i8")[0]), np.frombuffer(r["b"], "<i8")) for r in made if r["shard"] < 0}
    model.sizes[order] = {s: n for s, (n, _) in notes.items()}
    at = _offsets(model.sizes[order])
    model.hot[order + 1] = np.array(sorted(at[s] + int(i) for s, (_, some) in notes.items() for i in some), np.int64)
    parts = [r for r in made if r["shard"] >= 0]
    model.follows[order - 1] = frozenset(r["shard"] for r in parts)
    return np.sum([np.frombuffer(r["a"], "<i8") for r in parts], axis=0).tolist() if parts else [0] * 4


def _sum_contexts(spark: SparkSession, model: Model, order: int) -> list[int]:
    """Write the sums over the n-grams of an order by first part; counts of counts of these n-grams."""
    folder, bits, below, width = model.folder, model.bits, model.ids(order - 1), model.width(order - 1)
    shards = sorted(model.sizes[order])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("id").to_pylist():
                grams = model.grams(order)
                (first, end, _), small = grams.shard(s)
                counts = small.get(np.arange(int(end[-1])))
                if order < model.order:
                    before = model.preceding(order, np.arange(len(counts)) + grams.offset[s])
                    counts = np.where(before > 0, before, counts)
                starts = np.append(0, end[:-1]).astype(np.int64)
                rows = [np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2)]
                joint = _pack(first.astype(np.int64) // width, [first.astype(np.int64), rows[0], rows[1] | (rows[2] << 32)], 1 << bits)
                kinds = _pack(first.astype(np.int64) // width, [first.astype(np.int64), np.diff(end.astype(np.int64), prepend=0), np.zeros(len(first), np.int64)], 1 << bits)
                for made, kind in [*((x, 0) for x in joint), *((x, 1) for x in kinds)]:
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array([kind] * made.num_rows, pa.int32())], names=["shard", "a", "b", "c", "kind"])
                note = _note(s, _counts_of_counts(counts))
                yield pa.RecordBatch.from_arrays([*note.columns, pa.array([0], pa.int32())], names=["shard", "a", "b", "c", "kind"])

    def write(table: pa.Table) -> pa.Table:
        part = table.column("shard")[0].as_py()
        if part < 0:
            return table.select(["shard", "a"])
        values = np.zeros((4, min(width, below - part * width)), np.int64)
        for kind in (0, 1):
            some = table.filter(pc.equal(table.column("kind"), kind))
            at, b, c = _numbers(some, "a", True).astype(np.int64) - part * width, _numbers(some, "b", False).astype(np.int64), _numbers(some, "c", False).astype(np.int64)
            for k, x in ((3, b),) if kind else ((0, b), (1, c & 0xFFFFFFFF), (2, c >> 32)):
                np.add.at(values[k], at, x)
        values[3] -= values[1] + values[2]
        storage.write_arrays(f"{folder}/sums{order}-{part}", *(x for row in values for x in _small(row)))
        return pa.table({"shard": pa.array([part], pa.int32()), "a": pa.array([b""], pa.binary())})

    if not shards:
        model.sums[order] = frozenset()
        return [0] * 4
    todo = spark.createDataFrame([(s,) for s in shards], "id int").repartition(min(len(shards), 4096))
    made = todo.mapInArrow(sums, PACKED + ", kind int").groupBy("shard").applyInArrow(write, "shard int, a binary").collect()
    model.sums[order] = frozenset(r["shard"] for r in made if r["shard"] >= 0)
    return np.sum([np.frombuffer(r["a"], "<i8") for r in made if r["shard"] < 0], axis=0).tolist()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Files of a job's shuffles go when the job ends and not when the driver next frees memory, since each is read once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Count the model of ``order`` words (two at least) from all rows of ``texts`` (text)."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    with _shuffles_dropped(texts.sparkSession):
        return _trained(texts, order)


def _trained(texts: DataFrame, order: int) -> Model:
    spark = texts.sparkSession
    only = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs, bits = only.count(), max(6, int(np.ceil(np.log2(max(1, text_bytes(only) / SHARD_BYTES)))))
    model = _count_words(only, storage.shared_folder(spark, "language-model"), bits, docs, order)
    if not docs:
        return model
    for k in range(2, order + 1):
        seen = _count_grams(only, model, k)
        if k > 2:
            seen = _sum_contexts(spark, model, k - 1)
        model.discounts[k - 1] = _discounts(seen)
        if k == 2:
            d, more = model.discounts[1], model.distinct - seen[0] - seen[1]
            model.floor = (d[1] * seen[0] + d[2] * seen[1] + d[3] * more) / model.ids(2) / (model.distinct + 1)
    model.discounts[order] = _discounts(_sum_contexts(spark, model, order))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows, data, offsets in bytesets.pieces(batch, "text"):
                n, seen, base, value = known.score(*bytesets.word_hashes(data, offsets))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(seen), pa.array(np.full(len(n), known.tokens)), pa.array(base), pa.array(value)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents; a fifth of them is held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 1)
    model = train(docs.filter(~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
