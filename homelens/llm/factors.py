"""Removal of repeated word passages by relative Lempel-Ziv parsing.

Documents are packed into blocks and written once. A window is ``window`` consecutive words; it owns the
leftmost smallest ``GRAM``-word gram in it, its anchor, so equal windows own equal anchors at equal offsets. Blocks
first send the short names of their anchors; those that only one document has are done, none of their windows occurs again.
Of every other anchor a block sends its contexts, the words of all windows that own it, each distinct one once with
the smallest doc_id that holds it. Contexts meet in reference blocks by anchor. An anchor that more than ``HOT`` blocks
hold sends each window by itself to the reference block of that window, since such an anchor may have as many contexts as there are
documents.

A reference block indexes the windows of its contexts. In ascending doc_id, each context is factored
greedily against it: the window at hand is looked up, a match in a smaller document is carried on word by word
as far as it goes, and the next lookup is the first window that crosses the factor's end. Factors of a window and more are
duplicate spans. Names only choose where contexts meet; every match is one of words.

Defined results: null text has no words; texts shorter than the window lose nothing; a null doc_id comes after all
others; rows with one doc_id, equal or not, are no source for each other; an empty table gives no rows; other columns are
ignored. A long text is a block of its own, its words are named ``STEP`` bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homelens.llm import blocks, bytesets, storage
from homelens.llm.sizing import text_bytes

WINDOW, GRAM, HOT = 13, 6, 64
BLOCK, RANGE, REFERENCE = 4 << 20, 48 << 20, 8 << 20
STEP = 1 << 20
U = np.uint64
ANCHORS, CONTEXTS = 0, 1
NAMES = "shard int, block long, names binary, many binary"
SENT = "shard int, block long, holders binary, size long, contexts binary"
ANSWERS = "block long, kind int, shard int, codes binary"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept string"


def _numbers(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


class _Block:
    """Words of a block of documents and the anchors that their windows own."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.window = window
        self.block = table.column("block")[0].as_py()
        self.ids, sizes, self.raw = blocks.opened(table)
        data, cuts = np.frombuffer(self.raw, np.uint8), np.cumsum(np.append(0, sizes))
        inside = ~bytesets.SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a word can end only at white space or at a document's end
        edge[cuts] = True
        start = inside & np.append(True, ~inside[:-1] | edge[1 : len(data)])[: len(data)]
        stop = inside & np.append(~inside[1:] | edge[1 : len(data)], True)[: len(data)]
        self.first, self.end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.bounds = np.searchsorted(self.first, cuts)
        self.doc = np.repeat(np.arange(len(sizes)), np.diff(self.bounds))
        self.words = _hashes(data, self.first, self.end)
        starts = np.flatnonzero(np.arange(len(self.doc)) + window <= self.bounds[self.doc + 1])
        grams = _sliding(self.words, GRAM)
        owner, least = starts, grams[starts]
        for k in range(1, window - GRAM + 1):
            other = grams[starts + k]
            owner, least = np.where(other < least, starts + k, owner), np.minimum(other, least)
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        self.at, self.low, self.high = owner[head], starts[head], starts[np.append(head[1:], len(starts)) - 1] if len(head) else head
        self.names = bytesets.mix(grams[self.at])  # mixed: the least names are no even ranges

    def phrase(self, first: int, last: int) -> bytes:
        """Words first to last - 1, one space between them."""
        return b" ".join(self.raw[self.first[first] : self.end[last - 1]].split())


def _hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word."""
    out = np.empty(len(first), U)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(end, first[i] + STEP, "right")))
        begin, n = first[i], int(end[j - 1] - first[i])
        sums = np.zeros(n + 1, U)
        np.cumsum(bytesets.BYTE[data[begin : begin + n]] * bytesets.powers(bytesets.BASE, n), out=sums[1:])
        low = first[i:j] - begin
        out[i:j] = bytesets.mix((sums[end[i:j] - begin] - sums[low]) * bytesets.powers(bytesets.INVERSE, n)[low])
        i = j
    return out


def _sliding(words: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` words from each place on."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, U)
    for k in range(width):
        out = out * bytesets.BASE + words[k : k + n]
    return bytesets.mix(out)


def _short(names: np.ndarray, bits: int) -> np.ndarray:
    """The first 32 + bits bits of names: the range and a number in it."""
    return names >> U(32 - bits)


def _anchors(block: _Block, bits: int) -> pa.Table:
    """One row for each range of the block's distinct anchors: names in ascending order, and whether several documents have them."""
    short = _short(block.names, bits)
    order = np.argsort(short, kind="stable")
    short, doc = short[order], block.doc[block.at[order]]
    head = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.empty(0, np.int64)
    many = doc[head] != doc[np.append(head[1:], len(short)) - 1] if len(head) else np.empty(0, bool)
    short = short[head]
    of, first = np.unique(short >> U(32), return_index=True)
    cuts = [*first.tolist(), len(short)]
    names, flags = short.astype(np.uint32), many.astype(np.uint8)
    rows = [(int(s), block.block, names[i:j].tobytes(), flags[i:j].tobytes()) for s, i, j in zip(of.tolist(), cuts, cuts[1:], strict=False)]
    return _table(rows, NAMES)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _meet(table: pa.Table) -> pa.Table:
    """For each anchor that a block sent: 0 if one document has it, 2 if more than ``HOT`` blocks do, else 1."""
    names, many = _numbers(table.column("names"), np.uint32), _numbers(table.column("many"), np.uint8)
    each = np.array([len(x) // 4 for x in table.column("names").to_pylist()])
    order = np.argsort(names, kind="stable")
    head = np.flatnonzero(np.append(True, names[order][1:] != names[order][:-1]))
    count = np.diff(np.append(head, len(names)))
    code = ((count > 1) | (np.maximum.reduceat(many[order], head) > 0)).astype(np.uint8) + (count > HOT)
    codes = np.empty(len(names), np.uint8)
    codes[order] = np.repeat(code, count)
    cuts = np.append(0, np.cumsum(each))
    shard = table.column("shard")[0].as_py()
    return _table([(b, ANCHORS, shard, codes[i:j].tobytes()) for b, i, j in zip(table.column("block").to_pylist(), cuts, cuts[1:], strict=False)], ANSWERS)


class _Contexts:
    """The contexts of a block that may occur elsewhere: distinct ones with their smallest document, and where each occurs."""

    def __init__(self, block: _Block, answers: pa.Table, bits: int, references: int) -> None:
        codes = answers.filter(pc.equal(answers.column("kind"), ANCHORS)).sort_by("shard")
        _, of = np.unique(_short(block.names, bits), return_inverse=True)
        code = _numbers(codes.column("codes"), np.uint8)[of]
        low, high = block.low[code == 1], block.high[code == 1]
        hot = code > 1
        alone = np.concatenate([np.arange(a, b + 1) for a, b in zip(block.low[hot].tolist(), block.high[hot].tolist(), strict=True)] or [np.empty(0, np.int64)])
        self.low, self.count = np.append(low, alone), np.append(high - low, np.zeros(len(alone), np.int64)) + 1
        names = np.append(block.names[code == 1], _sliding(block.words, block.window)[alone] if len(alone) else np.empty(0, U))
        shard = (bytesets.mix(names + U(1)) % U(references)).astype(np.int64)
        self.holder = block.ids[block.doc[self.low]]
        known: dict[bytes, int] = {}
        last = self.low + self.count + block.window - 1
        self.of = np.array([known.setdefault(block.phrase(a, b), len(known)) for a, b in zip(self.low.tolist(), last.tolist(), strict=True)], np.int64)
        self.texts = list(known)
        self.least = np.full(len(known), blocks.LAST, np.int64)
        np.minimum.at(self.least, self.of, self.holder)
        self.shard = np.zeros(len(known), np.int64)
        self.shard[self.of] = shard
        self.order = np.argsort(self.shard, kind="stable")  # by reference block, as they are sent

    def sent(self, block: int) -> pa.Table:
        of, first = np.unique(self.shard[self.order], return_index=True)
        cuts = [*first.tolist(), len(self.order)]
        rows = []
        for s, i, j in zip(of.tolist(), cuts, cuts[1:], strict=False):
            some = self.order[i:j]
            raw = b"\n".join([self.texts[k] for k in some.tolist()])
            rows.append((s, block, self.least[some].tobytes(), len(raw), blocks.squeezed(raw)))
        return _table(rows, SENT)

    def matched(self, answers: pa.Table, window: int) -> np.ndarray:
        """First words of all windows that a document before theirs has."""
        bits = np.empty(len(self.texts), np.int64)
        codes = answers.filter(pc.equal(answers.column("kind"), CONTEXTS)).sort_by("shard")
        bits[self.order] = _numbers(codes.column("codes"), np.uint8)
        found = np.where(self.holder > self.least[self.of], 255, bits[self.of]) if len(self.of) else self.of
        ways = [self.low[(found >> k & 1 > 0) & (self.count > k)] + k for k in range(window - GRAM + 1)]
        return np.sort(np.concatenate(ways))


def _factored(texts: list[bytes], holders: list[int], window: int) -> list[int]:
    """For each context a number whose bit k says that a factor from a smaller document covers its window k."""
    index: dict[bytes, tuple[int, int]] = {}
    found = [0] * len(texts)
    for c in sorted(range(len(texts)), key=holders.__getitem__):
        words = texts[c].split(b" ")
        i = 0
        while i + window <= len(words):
            source, place = index.setdefault(b" ".join(words[i : i + window]), (c, i))
            if holders[source] >= holders[c]:
                i += 1
                continue
            length, other = window, texts[source].split(b" ")
            while i + length < len(words) and place + length < len(other) and words[i + length] == other[place + length]:
                length += 1
            for _ in range(length - window + 1):
                found[c] |= 1 << i
                i += 1  # ends at the first window that crosses the factor's end
    return found


def _reference(table: pa.Table, window: int) -> pa.Table:
    """Factors of all contexts that were sent to one reference block."""
    texts: list[bytes] = []
    cuts = [0]
    for size, raw in zip(table.column("size").to_pylist(), table.column("contexts").to_pylist(), strict=True):
        texts += blocks.unsqueezed(raw, size).split(b"\n")
        cuts.append(len(texts))
    found = np.array(_factored(texts, _numbers(table.column("holders"), "<i8").tolist(), window), np.uint8)
    shard = table.column("shard")[0].as_py()
    return _table([(b, CONTEXTS, shard, found[i:j].tobytes()) for b, i, j in zip(table.column("block").to_pylist(), cuts, cuts[1:], strict=False)], ANSWERS)


def _left(block: _Block, starts: np.ndarray) -> pa.Table:
    """The documents of a block without the words of the windows that begin at ``starts``."""
    change = np.zeros(len(block.words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + block.window, -1)
    gone = np.cumsum(change[:-1]) > 0
    total = np.append(0, np.cumsum(gone))
    fresh = np.ones(len(gone), bool)
    fresh[1:] = (gone[1:] != gone[:-1]) | (block.doc[1:] != block.doc[:-1])
    runs = np.flatnonzero(fresh)
    ends = np.append(runs[1:], len(gone))
    of = np.searchsorted(runs, block.bounds)
    spans, kept = [], []
    for k, begin in enumerate(block.bounds[:-1].tolist()):
        mine = list(zip(runs[of[k] : of[k + 1]].tolist(), ends[of[k] : of[k + 1]].tolist(), strict=True))
        spans.append([{"start": a - begin, "length": b - a} for a, b in mine if gone[a]])
        kept.append(b" ".join([block.phrase(a, b) for a, b in mine if not gone[a]]).decode())
    doc_ids = pa.array(block.ids, pa.int64(), mask=block.ids == blocks.LAST)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    columns = [doc_ids, pa.array(np.diff(block.bounds)), pa.array(np.diff(total[block.bounds])), pa.array(spans, kinds), pa.array(kept, pa.string())]
    return pa.table(columns, names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): each text without the words of passages of ``window`` words and more that
    a document with a smaller doc_id has as well; spans count words. The window is 7 to 13 words long."""
    if not GRAM < window <= GRAM + 7:
        raise ValueError("the window must have 7 to 13 words")
    total = text_bytes(docs)
    bits = max(6, min(24, (total // RANGE).bit_length()))
    references = max(64, total // REFERENCE)
    packed = blocks.pack(docs, int(min(16 * BLOCK, max(BLOCK, 64 * total**0.5))), "text-blocks")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _anchors(_Block(pa.Table.from_batches([batch.slice(k, 1)]), window), bits).to_batches()

    def ask(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(rows, window)
        return _Contexts(block, answers, bits, references).sent(block.block)

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(rows, window)
        return _left(block, _Contexts(block, answers, bits, references).matched(answers, window))

    by_block = packed.groupBy("block")
    shared = storage.materialize(packed.mapInArrow(names, NAMES).groupBy("shard").applyInArrow(_meet, ANSWERS), "shared-anchors")
    contexts = by_block.cogroup(shared.groupBy("block")).applyInArrow(ask, SENT)
    factors = contexts.groupBy("shard").applyInArrow(lambda table: _reference(table, window), ANSWERS)
    return by_block.cogroup(shared.unionByName(factors).groupBy("block")).applyInArrow(cut, RESULT)


def op13_reference_factors(spark, sf_dir: str) -> DataFrame:
    """What removal of passages that earlier documents have leaves of every document."""
    found = remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13),
named AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS name FROM windows),
found AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY name) < doc_id AS again FROM named),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
judged AS (
  SELECT e.doc_id, e.i, e.word, coalesce(bool_or(f.again) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
  FROM each e LEFT JOIN found f ON e.doc_id = f.doc_id AND e.i = f.i),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
