"""Fill-in-middle forms of documents from an index of distinct texts.

Rows are grouped by their text: a task joins equal texts of what it has read, ``HELD`` bytes at a time, and sends
each once with the documents that hold it; the receiving task compares contents, never only names. The unit
boundaries of a distinct text are found once there and kept as an Elias-Fano list, and each document that holds it
selects the two boundaries of its own seeded cut. A text that more than ``HOT`` documents (and a 100,000th
of all) hold is dealt over several tasks, each with a list of its own, so at most 100,000 names are broadcast.

A unit is white space with the word after it; white space that ends the text is a unit as well.

Defined results: null text is empty and stays plain; a null doc_id seeds like an empty number; rows that repeat
come out as often; a text of any length is one row in one task, its units are found ``STEP`` bytes at a
time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.llm import bytesets
from homelens.llm.sizing import partitions_for
from homelens.llm.tokenfiles import EliasFano

HOT = 2000
HELD = 32 << 20
STEP = 1 << 20
SENT = 4 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
GROUPS = "name long, share int, text string, ids array<bigint>, times array<bigint>"
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_TAKEN = pa.schema([("name", pa.int64()), ("share", pa.int32()), ("text", pa.string()), ("ids", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_GIVEN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of ``text`` ends, in code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    found, chars, inside = [], 0, False
    for k in range(0, len(data), STEP):
        part = data[k : k + STEP]
        word = ~bytesets.SPACE[part]
        before = np.append(inside, word[:-1])
        at = np.cumsum((part & 0xC0) != 0x80) + chars  # code points up to each byte
        found.append(at[before & ~word] - 1)
        chars, inside = int(at[-1]), bool(word[-1])
    if chars:
        found.append(np.array([chars]))  # the end of the last word or of the white space after it
    return np.concatenate(found) if found else np.empty(0, np.int64)


def boundaries(text: str) -> EliasFano:
    """The unit ends of ``text`` as an Elias-Fano list."""
    ends = unit_ends(text)
    return EliasFano.encode(ends, len(text) + 1)


def arranged(text: str, ends: EliasFano, seed: int, doc_id: int | None, share: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """(form, code points of the prefix and of the middle, output) of one document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= share or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    low, high = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
    a, b = (ends.select(k - 1) if k else 0 for k in (low, high))
    if h4 % 100 < spm:
        return "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output stands for."""

    def after(mark: str) -> Column:  # place of the first code point after the mark
        return F.locate(mark, output) + len(mark)

    def part(begin: str, end: str) -> Column:
        return F.substring(output, after(begin), F.locate(end, output) - after(begin))

    last = F.substring(output, after(MIDDLE), F.length(output))
    psm = F.concat(part(PREFIX, SUFFIX), last, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), last, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one task together, with the documents that hold them and how often each does."""
    held: dict[tuple[int, int, str], dict[int | None, int]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        weight = 0
        for (name, share, text), ids in held.items():
            rows.append((name, share, text, list(ids), list(ids.values())))
            weight += len(text) + 16 * len(ids)
            if weight > SENT:
                yield _batch(rows, _TAKEN)
                rows, weight = [], 0
        if rows:
            yield _batch(rows, _TAKEN)

    for batch in batches:
        names, shares, ids = (batch.column(c).to_pylist() for c in ("name", "share", "doc_id"))
        for name, share, doc_id, text in zip(names, shares, ids, batch.column("text"), strict=True):
            key = (name, share, text.as_py())
            if key not in held:
                held[key] = {}
                size += len(key[2])
            held[key][doc_id] = held[key].get(doc_id, 0) + 1
            size += 16
            if size > HELD:
                yield from sent()
                held.clear()
                size = 0
    yield from sent()


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``share`` percent of the documents cut in three and
    put in an order for infilling, ``spm`` percent of these with the suffix first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("name"))
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    least = max(HOT, rows // 100_000)
    hot = named.groupBy("name").count().filter(F.col("count") > least)
    hot = hot.select("name", F.ceil(F.col("count") / least).cast("int").alias("shares"))
    dealt = named.join(F.broadcast(hot), "name", "left")
    dealt = dealt.withColumn("share", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"), F.lit(0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, EliasFano] = {}  # lists of the texts of one name
        last = None
        rows: list[tuple] = []
        weight = 0

        for batch in batches:
            names, texts, ids, times = (batch.column(c) for c in ("name", "text", "ids", "times"))
            for k in range(batch.num_rows):
                name, whole = names[k].as_py(), texts[k].as_py()
                if name != last:
                    known, last = {}, name
                if whole not in known:
                    known[whole] = boundaries(whole)
                ends = known[whole]
                for doc_id, count in zip(ids[k].as_py(), times[k].as_py(), strict=True):
                    form, a, b, output = arranged(whole, ends, seed, doc_id, share, spm)
                    for _ in range(count):
                        rows.append((doc_id, ends.n, form, a, b, output))
                        weight += len(output) + 64
                        if weight > SENT:
                            yield _batch(rows, _GIVEN)
                            rows, weight = [], 0
        if rows:
            yield _batch(rows, _GIVEN)

    groups = dealt.select("name", "share", "text", "doc_id").mapInArrow(_joined, GROUPS)
    ordered = groups.repartition(partitions_for(size, 8 << 20), "name", "share").sortWithinPartitions("name", "share")
    return ordered.mapInArrow(cut, FORMS)


def op12_distinct_texts(spark, sf_dir: str) -> DataFrame:
    """Forms for infilling of all documents, with digests of the outputs and of the texts rebuilt from them."""
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    again = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
numbered AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || digest[1:8])::UBIGINT AS h1, ('0x' || digest[9:16])::UBIGINT AS h2,
         ('0x' || digest[17:24])::UBIGINT AS h3, ('0x' || digest[25:32])::UBIGINT AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS low, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbered),
parts AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
         array_to_string(units[high + 1:n], '') AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
