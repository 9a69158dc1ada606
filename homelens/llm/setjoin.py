"""N-gram Jaccard self-join by partitioning the universe of shingles.

Sizes fall into bands such that partners lie in the same or the next band. For the band of the larger
partner, at most H shingles differ. The universe is hashed into segments of two kinds, worth H + 1 and more
together: of one kind, worth 1, a document's key is its subset as it is; of the other, worth 2, its keys are
the subset and all its one-deletion neighbours, which meet those of any subset one shingle away. Segments in
which partners don't meet hold at least as many differences as they are worth, so partners meet in some
segment of any choice worth H + 1. A document is indexed under its rarest keys: it ranks its keys by how many
classes have them, and takes all up to the least rank at which segments worth H + 1 have all their keys. Of
two partners, the one with the lower such rank meets the other at a key of one of those segments, which the
other takes as well, so nothing is lost. Keys of a shared passage rank last, and a document with
enough keys of its own has no partner and takes none. Segments without shingles are keys only of documents
whose others are not worth H + 1. How many segments of each kind a band gets is allotted by the least expected
cost. Both bands' segments of a document are indexed.

Documents with equal sets are one class from the start. Classes that share a key are compared exactly on their
sets, first each with the key's hub, the class that meets most others. A key whose other classes then lie in one
component is settled, as nothing but components is asked for; that is how the largest groups of near copies end,
at one comparison a copy. Classes of the other keys form clusters, inside which every pair that lies in
different components is verified in tiles of ``TILE`` classes, so that no task holds a large cluster, and each
tile pair returns a spanning forest of its links only.

Defined results: null, empty and blank text has an empty set and links with nothing; repeated rows and
equal texts share a component; an empty table gives no rows; other columns are ignored; rows without
doc_id can link others and are linked, but name no component. A row is told from others by its doc_id and a
hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.llm import bytesets, storage
from homelens.llm.components import connected_components
from homelens.llm.sizing import text_bytes

TILE = 128
PART = 64
SALTS = 32
PLAIN = 0.6
WEAK = 1000
SHARD_BITS = 7
U = np.uint64


def allocate(size: int, differ: int) -> tuple[int, int]:
    """(segments, how many of them with deletions) of least expected cost for sets of ``size`` shingles.

    A key costs 1; a document whose rare shingles, taken as ``PLAIN`` of all, fill too few segments must go by
    frequent keys, each of which costs ``WEAK``. Shingles fall into segments as Poisson counts.
    """
    need, best = differ + 1, (np.inf, 0, 0)
    for spare in sorted({int(np.ceil(need * k / 10)) for k in range(21)}):
        for deleting in sorted({(need + spare) * k // 8 for k in range(5)}):
            exact = need + spare - 2 * deleting
            mean = size / (exact + deleting)
            rare = PLAIN * mean
            one, two = np.exp(-rare), (1 + rare) * np.exp(-rare)
            expected, deviation = exact * one + 2 * deleting * two, np.sqrt(exact * one * (1 - one) + 4 * deleting * two * (1 - two))
            over = 0.5 * erfc((spare + 0.5 - expected) / (1.4142 * deviation + 1e-9))
            cost = exact + deleting * (1 + mean) + WEAK * over * (exact * one + deleting * two)
            best = min(best, (cost, exact + deleting, deleting))
    return best[1:]


class Scheme:
    """Bands and their allotted segments for a threshold of ``percent`` and sets up to any size."""

    def __init__(self, percent: int) -> None:
        self.percent, self.starts, self.allotted = percent, [1], []

    def grow(self, size: int) -> None:
        while self.starts[-1] <= size or len(self.starts) < 3:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        ends = np.array(self.starts[1:], np.int64) - 1
        self.differ = (100 - self.percent) * 2 * ends // (100 + self.percent)
        for end, differ in list(zip(ends.tolist(), self.differ.tolist(), strict=True))[len(self.allotted) :]:
            self.allotted.append(allocate(end, differ))
        self.segments, self.deleting = np.array(self.allotted, np.int64).T

    def band(self, sizes: np.ndarray) -> np.ndarray:
        if self.starts[-3:][0] <= sizes.max(initial=1) or len(self.starts) < 4:
            self.grow(int(sizes.max(initial=1)))
        return np.searchsorted(self.starts, sizes, "right") - 1

    def keys(self, tokens: np.ndarray, bounds: np.ndarray, slack_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index keys, row of each, tag of each, slack of each row in its bands of even and odd number) for sorted
        sets of hashes; sets whose partners must be equal have no keys. A tag holds the segment's number, its
        worth (0 if a key of it may be that of no shingles) and whether the band's number is odd; slack is what
        the filled segments are worth less what must be indexed."""
        sizes = np.diff(bounds)
        own = self.band(np.maximum(sizes, 1))
        row = np.repeat(np.arange(len(sizes)), sizes)
        scrambled = bytesets.mix(tokens ^ U(0x5851F42D4C957F2D))
        keys, rows, tags = [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        slack, every = np.zeros((len(sizes), 2), np.int64), np.arange(len(sizes))
        for step in (0, 1):
            band = own + step
            m, deleting = self.segments[band], self.deleting[band]
            live = (self.differ[band] > 0) & (sizes > 0)
            if not live.any():
                continue
            seg = ((tokens >> U(32)) * m[row].astype(U)) >> U(32)
            new = np.ones(len(tokens), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(scrambled, first) if len(first) else scrambled[:0]
            count = np.diff(np.append(first, len(tokens)))
            owner, segment = row[first], seg[first]
            worth = 1 + (segment.astype(np.int64) < deleting[owner])
            filled = np.bincount(owner, np.where(count >= worth, worth, 0), minlength=len(sizes)).astype(np.int64)
            slack[every, band % 2] = np.where(live, filled - self.differ[band] - 1, 0)
            if slack_only:
                continue
            few = live & (filled <= self.differ[band])
            label = bytesets.mix((band[owner].astype(U) << U(40)) | segment)
            tag = (segment.astype(np.int64) << 3) | np.where(count >= worth, worth, 0) << 1 | band[owner] % 2
            keep = np.flatnonzero(live[owner])
            keys.append(bytesets.mix(total[keep] + label[keep]))
            rows.append(owner[keep])
            tags.append(tag[keep])
            run = np.cumsum(new) - 1
            cut = np.flatnonzero(((worth == 2) & live[owner] & ((count > 1) | few[owner]))[run])
            keys.append(bytesets.mix(total[run[cut]] - scrambled[cut] + label[run[cut]]))
            rows.append(row[cut])
            tags.append(tag[run[cut]])
            for r in np.flatnonzero(few):
                absent = np.setdiff1d(np.arange(m[r]), segment[owner == r].astype(np.int64))
                keys.append(bytesets.mix(bytesets.mix((U(band[r]) << U(40)) | absent.astype(U))))
                rows.append(np.full(len(absent), r))
                tags.append((absent << 3) | band[r] % 2)
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(tags), slack


def _classes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    sums = np.concatenate([[U(0)], np.cumsum(bytesets.mix(tokens ^ U(0xD1342543DE82EF95)), dtype=U)])
    return bytesets.mix((sums[bounds[1:]] - sums[bounds[:-1]]) + bytesets.mix(np.diff(bounds).astype(U))).view(np.int64)


def _sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    words, at = bytesets.word_hashes(data, offsets)
    return bytesets.shingles(words, at, width)


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def own_key(doc: Column, text: Column) -> list[Column]:
    """Join keys of a row, without nulls."""
    return [doc.isNull().alias("_idless"), F.coalesce(doc, F.lit(0)).cast("long").alias("_own"), text.alias("_tid")]


def signatures(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, tid, n, cls, even, odd): size, class and slack (see ``Scheme.keys``) of each document's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for batch in batches:
            for rows, data, offsets in bytesets.pieces(batch, "text", 1 << 20):
                tokens, bounds = _sets(rows, data, offsets, width)
                slack = scheme.keys(tokens, bounds, slack_only=True)[-1]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tid"), *map(pa.array, (np.diff(bounds), _classes(tokens, bounds), slack[:, 0], slack[:, 1]))], names=["doc_id", "tid", "n", "cls", "even", "odd"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("tid"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, tid long, n long, cls long, even long, odd long")


def _parts(values: np.ndarray, cuts: np.ndarray, kind: type) -> pa.Array:
    """Packed slices of ``values``."""
    values = values.astype(kind)
    return pa.array([values[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def _whole(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def index_entries(docs: DataFrame, percent: int, width: int, bits: int) -> DataFrame:
    """(shard, owners, counts, keys, low, high): index keys and tags of many classes, packed by ranges of keys, so
    that the shuffle has few rows and hot keys weigh as much as others."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, owner, tags = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = (keys >> U(64 - bits)).astype(np.int64)
            order = np.lexsort((tags, keys, owner, shard))
            keys, owner, tags, shard = keys[order], owner[order], tags[order], shard[order]
            once = np.ones(len(keys), bool)  # equal sets of a batch are indexed once
            once[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (tags[1:] != tags[:-1])
            keys, owner, tags, shard = keys[once] << U(bits) >> U(32), owner[once], tags[once], shard[once]
            some, start = np.unique(shard, return_index=True)
            cuts = np.append(start, len(shard))
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])
            first = np.flatnonzero(new)
            each = np.searchsorted(first, cuts)
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), _parts(owner[first], each, np.int64), _parts(np.diff(np.append(first, len(owner))), each, np.int32), _parts(keys, cuts, np.uint32), _parts(tags & 0xFFFF, cuts, np.uint16), _parts(tags >> 16, cuts, np.uint32)],
                names=["shard", "owners", "counts", "keys", "low", "high"],
            )

        for batch in batches:
            for rows, data, offsets in bytesets.pieces(batch, "text", 1 << 20):
                tokens, bounds = _sets(rows, data, offsets, width)
                keys, row, tags, _ = scheme.keys(tokens, bounds)
                if len(keys):
                    held.append((keys, _classes(tokens, bounds)[row], tags))
                    size += len(keys)
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(deal, "shard int, owners binary, counts binary, keys binary, low binary, high binary")


def shared_entries(entries: DataFrame, bits: int) -> DataFrame:
    """(home, shard, owners, keys, tags, holders): the entries whose key several classes have, with how many
    have it, packed by the range of their class."""

    def meet(table: pa.Table) -> pa.Table:
        keys, tags = _whole(table, "keys", np.uint32), _whole(table, "high", np.uint32).astype(np.int64) << 16 | _whole(table, "low", np.uint16)
        owner = np.repeat(_whole(table, "owners", np.int64), _whole(table, "counts", np.int32))
        order = np.lexsort((tags, owner, keys))
        keys, owner, tags = keys[order], owner[order], tags[order]
        again = np.zeros(len(keys), bool)
        again[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
        copy = again.copy()
        copy[1:] &= tags[1:] == tags[:-1]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new) - 1
        holders = np.bincount(group, ~again)[group].astype(np.int64)
        keep = (holders > 1) & ~copy
        keys, owner, tags, holders = keys[keep], owner[keep], tags[keep], holders[keep]
        home = (owner.view(U) >> U(64 - bits)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        some, start = np.unique(home[order], return_index=True)
        cuts = np.append(start, len(order))
        packed = [_parts(x[order], cuts, kind) for x, kind in ((owner, np.int64), (keys, np.uint32), (tags, np.int64), (holders, np.int64))]
        shard = pa.array(np.full(len(some), table.column("shard")[0].as_py()), pa.int32())
        return pa.table([pa.array(some, pa.int32()), shard, *packed], names=["home", "shard", "owners", "keys", "tags", "holders"])

    return entries.groupBy("shard").applyInArrow(meet, "home int, shard int, owners binary, keys binary, tags binary, holders binary")


def rarest_entries(shared: DataFrame, signed: DataFrame, bits: int) -> DataFrame:
    """(shard, keys, owners): of each class and band, the entries up to the least rank at which enough segments
    have all their keys; keys rank by how many classes have them, so those of one class alone come first."""

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        names, first = np.unique(right.column("cls").to_numpy(), return_index=True)
        slack = np.stack([right.column(x).to_numpy()[first] for x in ("even", "odd")], 1).ravel()
        owner, tags, keys = _whole(left, "owners", np.int64), _whole(left, "tags", np.int64), _whole(left, "keys", np.uint32)
        shard = np.repeat(left.column("shard").to_numpy(), [len(x) // 4 for x in left.column("keys").to_pylist()])
        rank = _whole(left, "holders", np.int64) << 32 | keys
        group = np.searchsorted(names, owner) * 2 + (tags & 1)
        order = np.lexsort((rank, tags, group))
        group, tags, rank, shard, owner, keys = (x[order] for x in (group, tags, rank, shard, owner, keys))
        last = np.ones(len(group), bool)
        last[:-1] = (group[1:] != group[:-1]) | (tags[1:] != tags[:-1])
        of, worst, worth = group[last], rank[last], tags[last] >> 1 & 3
        order = np.lexsort((worst, of))
        of, worst, worth = of[order], worst[order], worth[order]
        lone = slack - np.bincount(of, worth, minlength=len(slack)).astype(np.int64)
        sums = np.cumsum(worth)
        start = np.searchsorted(of, of)
        enough = sums - sums[start] + worth[start] + lone[of] >= 0 if len(of) else np.zeros(0, bool)
        top = np.full(len(slack), np.iinfo(np.int64).max)
        np.minimum.at(top, of[enough], worst[enough])
        top[lone >= 0] = -1
        keep = rank <= top[group]
        shard, keys, owner = shard[keep], keys[keep], owner[keep]
        order = np.argsort(shard, kind="stable")
        some, at = np.unique(shard[order], return_index=True)
        cuts = np.append(at, len(order))
        return pa.table([pa.array(some, pa.int32()), _parts(keys[order], cuts, np.uint32), _parts(owner[order], cuts, np.int64)], names=["shard", "keys", "owners"])

    home = F.shiftrightunsigned("cls", 64 - bits).cast("int")
    asked = signed.filter("n > 0").select("cls", "even", "odd").distinct().select(home.alias("home"), "cls", "even", "odd")
    return shared.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(choose, "shard int, keys binary, owners binary")


def candidate_keys(docs: DataFrame, signed: DataFrame, percent: int, width: int) -> DataFrame:
    """(key, cls, n): every class of each key that several classes are indexed under, and how many those are."""

    def meet(table: pa.Table) -> pa.Table:
        keys, owner = _whole(table, "keys", np.uint32), _whole(table, "owners", np.int64)
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[new], owner[new]
        _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
        keep = n[of] > 1
        key = np.int64(table.column("shard")[0].as_py()) << 32 | keys[keep].astype(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "cls": pa.array(owner[keep], pa.int64()), "n": pa.array(n[of][keep], pa.int64())})

    bits = max(SHARD_BITS, (text_bytes(docs) >> 24).bit_length())
    shared = shared_entries(index_entries(docs, percent, width, bits), bits)
    return rarest_entries(shared, signed, bits).groupBy("shard").applyInArrow(meet, "key long, cls long, n long")


def key_hubs(keys: DataFrame) -> DataFrame:
    """(key, hub): of each key the class that meets most others by all its keys, as the original of near copies does."""
    weight = keys.groupBy("cls").agg(F.sum("n").alias("w"))
    return keys.select("key", "cls").join(weight.hint("merge"), "cls").groupBy("key").agg(F.max_by("cls", F.struct("w", "cls")).alias("hub"))


def _join_spread(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, cls) joined with the one row of each key in ``sizes``; a frequent key is ``SALTS`` tasks' work."""
    salt = F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")
    copies = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (hub, cls) that are alike. The classes of a hub are dealt in parts of ``PART``, each with the hub's set."""
    units = max(64, pairs.count() // 512)

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("hub", "ascending"), ("part", "ascending")])
        hub, part, cls = (table.column(c).to_numpy() for c in ("hub", "part", "cls"))
        tokens = table.column("tokens").to_pylist()
        size = np.array([len(x) // 8 for x in tokens], np.int64)
        group = np.cumsum(np.append(False, (hub[1:] != hub[:-1]) | (part[1:] != part[:-1])))
        centre = hub == cls
        distinct, token = np.unique(np.frombuffer(b"".join(tokens), U), return_inverse=True)
        row = np.repeat(np.arange(len(size)), size)
        place = group[row] * len(distinct) + token
        known = np.unique(place[centre[row]])
        hit = known[np.minimum(np.searchsorted(known, place), max(len(known) - 1, 0))] == place if len(known) else np.zeros(len(place), bool)
        both = np.bincount(row[hit], minlength=len(size))
        of_hub = np.bincount(group[centre], size[centre], minlength=int(group[-1]) + 1).astype(np.int64)[group]
        linked = ~centre & (100 * both >= percent * (of_hub + size - both))
        return pa.table({"a": pa.array(hub[linked], pa.int64()), "b": pa.array(cls[linked], pa.int64())})

    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = _join_spread(pairs, parts, "hub").select("hub", "cls", F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("part"))
    centres = dealt.select("hub", F.col("hub").alias("cls"), "part").distinct()
    rows = storage.materialize(dealt.unionByName(centres), "set-pairs").join(sets.hint("merge"), "cls")
    unit = F.pmod(F.xxhash64("hub", "part"), F.lit(units))
    return rows.select(unit.alias("unit"), "hub", "part", "cls", "tokens").groupBy("unit").applyInArrow(verify, "a long, b long")


def unsettled(keys: DataFrame, hubs: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, cls, part) of the keys whose classes, but the hub, whose pairs are all judged, lie in several components ``parts`` (node, component)."""
    known = parts.select(F.col("node").alias("cls"), F.col("component").alias("part"))
    others = keys.select("key", "cls").join(hubs.hint("merge"), "key").filter("cls <> hub")
    placed = others.join(known.hint("merge"), "cls", "left").select("key", "cls", F.coalesce("part", "cls").alias("part"))
    placed = storage.materialize(placed, "set-placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("cls").alias("first")).filter("low <> high")
    return placed.join(mixed.select("key", "first").hint("merge"), "key")


def _forest(names: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one tile as (smallest name of the group, name), from exact intersection sizes."""
    k = len(names)
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(k), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = np.zeros(len(flat), bool)
    same[1:] = flat[1:] == flat[:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    column = np.cumsum(~same[shared]) - 1
    owner = owner[shared]
    common = np.zeros((k, k), np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        part = (column >= start) & (column < start + 8192)
        grid = np.zeros((k, min(8192, int(column[-1]) + 1 - start)), np.float32)
        grid[owner[part], column[part] - start] = 1
        common += grid @ grid.T
    both = common.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.arange(k)
    while True:
        low = np.where(linked, label[None, :], k).min(1)
        low = np.minimum(low, label)[np.minimum(low, label)]
        if (low == label).all():
            break
        label = low
    child = np.flatnonzero(label != np.arange(k))
    return names[label[child]], names[child]


def class_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(cls, tokens): the sets of ``members`` (_idless, _own, _tid, cls), made again from one text of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in bytesets.pieces(batch, "text", 1 << 20):
                tokens, bounds = _sets(rows, data, offsets, width)
                right = pa.array(_classes(tokens, bounds) == rows.column("cls").to_numpy())
                yield pa.RecordBatch.from_arrays([rows.column("cls"), _binaries(tokens, bounds)], names=["cls", "tokens"]).filter(right)

    keys = ["_idless", "_own", "_tid"]
    texts = docs.select(*own_key(F.col("doc_id").cast("long"), text_key()), F.col("text").cast("string"))
    chosen = texts.join(members.hint("merge"), keys).dropDuplicates(keys)  # one plan at every size
    return chosen.select("cls", "text").mapInArrow(sets, "cls long, tokens binary")


def cluster_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that connect the classes of each cluster as all its links between different parts do.
    ``members``: (cls, part, cluster, tiles)."""
    units = max(64, members.count() // 64)

    def verify(table: pa.Table) -> pa.Table:
        cluster, a, b, part = (table.column(x).to_numpy() for x in ("cluster", "a", "b", "part"))
        names, tokens = table.column("cls").to_numpy(), table.column("tokens").to_pylist()
        order = np.lexsort((names, b, a, cluster))
        new = np.ones(len(order), bool)
        new[1:] = (cluster[order][1:] != cluster[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        head = np.flatnonzero(new)
        for i, j in zip(head, np.append(head[1:], len(order)), strict=True):
            group = order[i:j]
            group = group[np.append(True, names[group][1:] != names[group][:-1])]
            if len(group) > 1 and (part[group] != part[group[0]]).any():
                x, y = _forest(names[group], [np.frombuffer(tokens[k], U) for k in group], percent)
                left.append(x)
                right.append(y)
        return pa.table({"a": pa.array(np.concatenate(left), pa.int64()), "b": pa.array(np.concatenate(right), pa.int64())})

    tile = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    pairs = members.withColumn("t", tile).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.withColumn("a", F.least("t", "o")).withColumn("b", F.greatest("t", "o")).join(sets.hint("merge"), "cls")
    unit = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("cluster"), F.lit(units))).otherwise(F.xxhash64("cluster", "a", "b"))
    return pairs.select(unit.alias("unit"), "cluster", "a", "b", "cls", "part", "tokens").groupBy("unit").applyInArrow(verify, "a long, b long")


def class_links(docs: DataFrame, signed: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, component) of all classes that link with another: stars around each key's hub first, then what they leave open."""
    keys = storage.materialize(candidate_keys(docs, signed, percent, width), "set-keys")
    members = keys.select("cls").distinct().join(classes.hint("merge"), "cls").select(*own_key(F.col("first.doc_id"), F.col("first.tid")), "cls")
    sets = storage.materialize(class_sets(docs, members, width), "set-tokens")
    hubs = storage.materialize(key_hubs(keys), "set-hubs")
    pairs = keys.select("key", "cls").join(hubs.hint("merge"), "key").filter("cls <> hub").select("hub", "cls").distinct()
    links = storage.materialize(star_links(storage.materialize(pairs, "set-stars"), sets, percent), "set-star-links")
    parts = storage.materialize(connected_components(links), "set-parts")
    left = storage.materialize(unsettled(keys, hubs, parts), "set-unsettled")
    if left.isEmpty():
        return parts
    clusters = connected_components(left.select(F.col("first").alias("a"), F.col("cls").alias("b")))
    clusters = storage.materialize(clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "set-clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = _join_spread(clusters, sizes, "cluster").join(left.select("cls", "part").distinct().hint("merge"), "cls")
    more = cluster_links(storage.materialize(placed, "set-members"), sets, percent)
    return connected_components(links.unionByName(more))


def row_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, tid, n, component struct<idless, doc_id, tid>) of every row, see ``jaccard_components``; a component
    is named by its first row: the smallest doc_id, rows without one last, then the smallest hash of the text."""
    signed = storage.materialize(signatures(docs, percent, width), "set-signatures")
    named = F.struct(F.col("doc_id").isNull().alias("idless"), "doc_id", "tid")
    classes = storage.materialize(signed.filter("n > 0").groupBy("cls").agg(F.min(named).alias("first")), "set-classes")
    links = class_links(docs, signed, classes, percent, width)
    linked = storage.materialize(links.join(classes.select(F.col("cls").alias("node"), "first"), "node"), "set-links")
    least = storage.materialize(linked.groupBy("component").agg(F.min("first").alias("least")), "set-least")
    found = linked.join(least, "component").select(F.col("node").alias("cls"), "least")
    lone = classes.join(found.hint("merge"), "cls", "left").select("cls", F.coalesce("least", "first").alias("component"))
    lone = storage.materialize(lone, "set-components")
    whole = signed.select("doc_id", "tid", "n", "cls").join(lone.hint("merge"), "cls", "left")
    return whole.select("doc_id", "tid", "n", F.when(F.col("n") == 0, named).otherwise(F.col("component")).alias("component"))


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of documents whose sets of ``width``-word shingles have
    a Jaccard similarity of ``percent`` or more; component_id is the smallest doc_id."""
    return row_components(docs, percent, width).select("doc_id", F.col("n").alias("n_shingles"), F.col("component.doc_id").alias("component_id"))


def op1_universe_partition(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at a similarity of 0.9."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 90, 3)
