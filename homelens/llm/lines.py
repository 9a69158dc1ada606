"""Line dedup by deletion neighbourhoods, in DataFrame functions only.

A line is its words (runs other than space, tab, line feed, vertical tab, form feed, carriage return). It
goes if an earlier line, by doc_id and line number, is within its edit bound: no edit for lines under
``FUZZY`` words, for others one word put in, left out or replaced. Lines are first reduced to distinct ones. Two
lines one word apart agree on their first or their second half; only lines that share a half with another
line emit their variants: the line without its i-th word, keyed by i for replacements and without i for
words left out. Within a key the earliest line stands for all, so no key makes more rows than it has
members, and each match is verified on the words.

Defined results: null and empty text has no lines; blank lines stay; rows with the same doc_id and text are one
document read twice and keep the same lines; rows without doc_id come last; an empty table gives no rows;
other columns, whatever their names, stay as they are. Different texts with one doc_id, or without any, are
documents of their own, in the order of their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.llm import columns, storage

FUZZY = 8
_LAST = 2**63 - 1


# Joins with a side of corpus size name their strategy, so that plans do not change with the size of the input.
def _key() -> list[Column]:
    """(did, tid) of a document: its doc_id, or the largest long, and a hash of its text and of whether it has an id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tid")]


def _lines(docs: DataFrame) -> DataFrame:
    """(did, tid, no, line) of every line with a word."""
    out = docs.select(*_key(), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return out.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _words() -> Column:
    spaced = "IF(line rlike '[\\\\x09-\\\\x0D]', regexp_replace(line, '[\\\\x09-\\\\x0D]', ' '), line)"  # splitting at one plain character is fast
    return F.expr(f"array_remove(split({spaced}, ' '), '')")


def _classes(lines: DataFrame) -> DataFrame:
    """(did, tid, no, h1, h2, n, h3, h4): two 64-bit names of the words, and further half keys of lines over ``FUZZY`` words.

    A line of n words may meet one of n or of n + 1 words by the halves of n, and one of n - 1 by those of
    n - 1. The keys of the halves of n name the line as well; shorter lines have names of their own.
    """
    w = lines.select("did", "tid", "no", _words().alias("w")).withColumn("n", F.size("w"))
    left = lambda m: f"xxhash64({m}, 0, slice(w, 1, ({m}) div 2))"
    right = lambda m: f"xxhash64({m}, 1, slice(w, n - (({m}) - ({m}) div 2) + 1, ({m}) - ({m}) div 2))"
    names = [f"IF(n < {FUZZY}, xxhash64(w), {left('n')}) AS h1", f"IF(n < {FUZZY}, xxhash64(17, w), {right('n')}) AS h2"]
    return w.selectExpr("did", "tid", "no", "n", *names, f"IF(n > {FUZZY}, {left('n - 1')}, NULL) AS h3", f"IF(n > {FUZZY}, {right('n - 1')}, NULL) AS h4")


def _running(array: str) -> Column:
    """0 and the exclusive or of the first 1, 2 .. elements. Appending copies the array, so it is done within runs
    of about the square root of the length, then over the runs' totals."""
    append = "(s, x) -> concat(s, array(element_at(s, -1) ^ {}))"
    runs = f"transform(sequence(0, (size(a) - 1) div k), c -> aggregate(slice(a, c * k + 1, k), array(0L), {append.format('x')}))"
    totals = f"aggregate(r, array(0L), {append.format('element_at(x, -1)')})"
    joined = "concat(flatten(transform(r, (w, c) -> transform(slice(w, 1, size(w) - 1), x -> x ^ t[c]))), array(element_at(t, -1)))"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return F.expr(let("a", array, let("k", "CAST(ceil(sqrt(size(a))) AS INT)", let("r", runs, let("t", totals, joined)))))


def _variants(lines: DataFrame) -> DataFrame:
    """(key, rank, kind) of all variants: kind 0 without word i and keyed by i, 1 without word i, 2 the line itself.

    A key is the exclusive or of the words' hashes, each with its place; ``low`` runs over the words before
    word i, ``high`` over those after it, one place lower.
    """
    placed = lines.select("rank", F.size("w").alias("n"), F.expr("transform(w, (x, i) -> xxhash64(x, i))").alias("h"), F.expr("transform(w, (x, i) -> xxhash64(x, i - 1))").alias("g"))
    runs = placed.select("rank", "n", "h", _running("h").alias("low"), _running("reverse(g)").alias("high"))
    whole = F.array(F.struct(F.expr("element_at(low, -1)").alias("key"), F.lit(2).alias("kind")))
    replaced = F.expr("transform(h, (x, i) -> named_struct('key', xxhash64(n, i, element_at(low, -1) ^ x), 'kind', 0))")
    left_out = F.expr(f"IF(n > {FUZZY}, transform(h, (x, i) -> named_struct('key', low[i] ^ high[n - 1 - i], 'kind', 1)), CAST(array() AS array<struct<key:bigint,kind:int>>))")
    return runs.select("rank", F.explode(F.concat(whole, replaced, left_out)).alias("v")).select("v.key", "rank", "v.kind")


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of distinct lines that an earlier one differs from by one word.

    Candidates get a number that grows with (did, tid, no), so that the earliest of a key is a minimum of longs.
    """
    halves = F.when(F.col("n") > FUZZY, F.array("h1", "h2", "h3", "h4")).when(F.col("n") == FUZZY, F.array("h1", "h2"))
    keys = distinct.select("h1", "h2", F.xxhash64("h1", "h2").alias("name"), F.col("at.did").alias("did"), F.col("at.tid").alias("tid"), F.col("at.no").alias("no"), F.explode(halves).alias("key"))
    shared = storage.materialize(keys.groupBy("key").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a <> b").select("key"), "line-halves")
    some = storage.materialize(keys.join(shared.hint("merge"), "key", "left_semi").select("did", "tid", "no", F.col("h1").alias("name1"), F.col("h2").alias("name2")).distinct(), "line-candidates")
    some = storage.materialize(some.repartitionByRange("did", "tid", "no").sortWithinPartitions("did", "tid", "no").withColumn("rank", F.monotonically_increasing_id()), "line-ranks")
    texts = _lines(docs).join(some.hint("merge"), ["did", "tid", "no"]).dropDuplicates(["did", "tid", "no"])
    lines = storage.materialize(texts.select("name1", "name2", "rank", _words().alias("w")), "line-words")
    variants = _variants(lines)
    firsts = variants.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("rank"))).alias(f"f{k}") for k in (0, 1, 2)], *[F.max(F.when(F.col("kind") == k, F.col("rank"))).alias(f"l{k}") for k in (0, 1)])
    met = storage.materialize(firsts.filter("f0 <> l0 OR (f1 IS NOT NULL AND f2 IS NOT NULL)").select("key", "f0", "f1", "f2"), "line-keys")
    hub = F.when(F.col("kind") == 0, F.col("f0")).when(F.col("kind") == 1, F.col("f2")).otherwise(F.col("f1"))
    pairs = variants.join(met.hint("merge"), "key").select("rank", hub.alias("hub")).filter("hub < rank").distinct()
    pairs = storage.materialize(pairs, "line-pairs")
    a, b = lines.select("name1", "name2", "rank", F.col("w").alias("aw")), lines.select(F.col("rank").alias("hub"), F.col("w").alias("bw"))
    both = pairs.join(a.hint("merge"), "rank").join(b.hint("merge"), "hub")
    longer, shorter = "IF(size(aw) > size(bw), aw, bw)", "IF(size(aw) > size(bw), bw, aw)"
    ordered = both.select("name1", "name2", F.expr(longer).alias("x"), F.expr(shorter).alias("y")).withColumn("unlike", F.expr("zip_with(slice(x, 1, size(y)), y, (p, q) -> p <> q)"))
    place = ordered.withColumn("d", F.expr("CAST(array_position(unlike, true) AS INT)"))
    apart = """IF(size(x) = size(y), d = 0 OR slice(x, d + 1, size(y)) = slice(y, d + 1, size(y)),
        size(x) = size(y) + 1 AND (d = 0 OR slice(x, d + 1, size(y)) = slice(y, d, size(y))))"""
    return place.filter(F.expr(apart)).select(F.col("name1").alias("h1"), F.col("name2").alias("h2")).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(did, tid, gone array<int>): numbers of the lines that go, for documents that lose any; see ``_key``."""
    lines = storage.materialize(_classes(_lines(docs)), "lines")
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.struct("did", "tid", "no")).alias("at"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n", "h3", "h4")])
    distinct = storage.materialize(distinct, "line-classes")
    repeated = distinct.filter("times > 1").select("h1", "h2", "at", F.lit(False).alias("near"))
    near = _near(docs, distinct).select("h1", "h2", F.lit(None).cast(distinct.schema["at"].dataType).alias("at"), F.lit(True).alias("near"))
    judged = storage.materialize(repeated.unionByName(near), "line-judged")
    gone = lines.select("did", "tid", "no", "h1", "h2").join(judged.hint("merge"), ["h1", "h2"]).filter(F.col("near") | (F.struct("did", "tid", "no") != F.col("at")))
    return storage.materialize(gone.groupBy("did", "tid").agg(F.array_sort(F.collect_set("no")).alias("gone")), "line-gone")


def dedup_lines(docs: DataFrame, names: tuple[str, str] = ("_gone", "_kept")) -> DataFrame:
    """``docs`` with the numbers of the lines removed and the text without them (null stays null) under ``names``;
    columns of ``docs`` with these names are replaced, all others stay."""
    gone = removed_lines(docs)
    did, tid = _key()
    lost, left = names
    named = gone.select(F.col("did").alias("_did"), F.col("tid").alias("_tid"), F.col("gone").alias(lost))
    joined = columns.packed(docs, "doc_id", "text").withColumn("_did", did).withColumn("_tid", tid).join(named.hint("merge"), ["_did", "_tid"], "left")
    split = F.expr(f"IF(`{lost}` IS NULL, text, array_join(transform(array(split(text, '\\n')), x -> array_join(transform(array_except(sequence(0, size(x) - 1), `{lost}`), i -> x[i]), '\\n')), ''))")
    return columns.unpacked(joined.withColumn(left, split), docs, "doc_id", "text", extra=names)


def op8_deletion_neighbourhood(spark, sf_dir: str) -> DataFrame:
    """Lines with words, lines removed and the text that stays, of every document."""
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    filled = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*"))
    return found.select("doc_id", filled.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.length(F.coalesce("_kept", F.lit(""))).cast("long").alias("kept_chars"), F.md5(F.coalesce("_kept", F.lit(""))).alias("kept_md5"))


ORACLE = f"""
WITH raw AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS no FROM documents
), lines AS (
    SELECT doc_id, no, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM raw
), classes AS (
    SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, len(any_value(w)) AS n, min(doc_id * 10000000 + no) AS pos FROM lines WHERE len(w) > 0 GROUP BY 1
), each AS (
    SELECT s, n, pos, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS cut FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM classes WHERE n >= {FUZZY})
), replaced AS (
    SELECT s, pos, min(pos) OVER (PARTITION BY n, i, cut) AS hub FROM each
), left_out AS (
    SELECT e.s AS longer, e.pos AS la, c.s AS shorter, c.pos AS sa FROM each e JOIN classes c ON c.s = e.cut WHERE e.n > {FUZZY}
), near AS (
    SELECT s FROM replaced WHERE hub < pos UNION SELECT longer FROM left_out WHERE sa < la UNION SELECT shorter FROM left_out WHERE la < sa
), judged AS (
    SELECT l.doc_id, l.no, l.line, len(l.w) > 0 AS filled,
        len(l.w) > 0 AND (c.pos <> l.doc_id * 10000000 + l.no OR n.s IS NOT NULL) AS gone
    FROM lines l LEFT JOIN classes c ON c.s = array_to_string(l.w, ' ') LEFT JOIN near n ON n.s = c.s
)
SELECT doc_id, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_removed,
    length(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_chars,
    md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_md5
FROM judged GROUP BY doc_id
"""
