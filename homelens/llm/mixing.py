"""Mixing sources to target weights by a splitting tree, in DataFrame functions only.

Documents fall into at most ``CELLS`` hash cells a source; neighbouring cells make the source's blocks.
Each source lays its blocks out as a deck: whole rounds, each in a permuted order of its own, then a round in
which blocks that do not fit the rest of the target stand at the end. Its quota is the number of draws that
reaches the target. A tree of multivariate hypergeometric splits parts the quotas of all sources among the output
shards: each node halves its shards and draws, source by source, how many of its blocks go left. Each shard then
draws as many cards of every deck as its leaf says, so draws are disjoint, and a document is taken once for each
draw of its block. Of a source's last block, the first that did not fit, the draw takes documents in a permuted
order, without those larger than the gap, up to the ``BACK``-th before the gap is full, then of all its other
documents what fits, largest first, by counts of sizes. Within a shard, documents are in hash order.

Everything but the documents themselves is at most ``CELLS`` rows a source. Null sources are one source
that sorts last. Defined results: null text has size 0 and takes 0; repeated rows are documents of their
own; an empty table gives no rows; other columns are ignored; hashes make reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homelens.llm import columns, storage
from homelens.llm.sizing import partitions_for

CELLS = 1024
BLOCK_DOCS = 64
BACK = 16
MOST = 3
SHARDS = 16


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, skey, cell, size): words of each text, without null keys."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"),
        F.pmod(F.xxhash64("doc_id", F.lit(71)), F.lit(CELLS)).cast("int").alias("cell"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sources: DataFrame) -> DataFrame:
    """``sources`` (skey, source, source_size, docs) with weight and target, one row a source.

    Weights 1, 2, 3 repeat in the order of the names. Sources sorted by the level at which they reach
    their cap are capped one after the other until the next one's cap is above the level of the rest.
    """
    weighed = sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    cap = F.lit(float(MOST)) * F.col("source_size")
    order = Window.orderBy("ratio", "skey")
    every = Window.partitionBy()
    ranked = weighed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", (F.sum("source_size").over(every) - before) / left)
    found = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "skey"))).over(every)
    return leveled.withColumn("target", F.least(F.col("cap"), F.coalesce(found, F.lit(0.0)) * F.col("weight"))).drop("cap", "ratio", "level")


def _draw(total: str, good: str, n: str, u: str) -> str:
    """SQL for a hypergeometric count: of ``n`` draws from ``total`` blocks, how many of ``good`` ones, at quantile ``u``."""
    lf = lambda x: f"(CASE WHEN {x} <= 1 THEN 0D ELSE {x} * ln({x}) - {x} + 0.5D * ln(6.283185307179586D * {x}) + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) END)"
    comb = lambda a, b: f"({lf(f'({a})')} - {lf(f'({b})')} - {lf(f'(({a}) - ({b}))')})"
    low, high = f"greatest(0L, {n} - ({total} - {good}))", f"least({n}, {good})"
    first = f"{comb(good, low)} + {comb(f'{total} - {good}', f'{n} - {low}')} - {comb(total, n)}"
    walk = f"""aggregate(sequence({low}, {high}), named_struct('lp', {first}, 'sum', 0D, 'x', CAST(NULL AS BIGINT)),
        (c, y) -> named_struct(
            'lp', IF(y < {high}, c.lp + ln(({good} - y) * 1D * ({n} - y) / ((y + 1) * 1D * ({total} - {good} - {n} + y + 1))), c.lp),
            'sum', c.sum + exp(c.lp),
            'x', IF(c.x IS NULL AND c.sum + exp(c.lp) >= {u}, y, c.x)), c -> coalesce(c.x, {high}))"""
    return f"IF({high} <= {low}, {low}, {walk})"


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """(skey, by_shard array<bigint>) from (skey, draws): exact block quotas of each shard, by a tree of splits.

    The sources, one number each, make one array a tree node. ``shards`` is a power of two.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("skey", "draws"))).alias("k")).select(F.lit(0).alias("node"), F.expr("transform(k, x -> x.skey)").alias("names"), F.expr("transform(k, x -> x.draws)").alias("k"))
    width = shards
    while width > 1:
        u = f"((pmod(xxhash64({seed}, node, {width}, size(s.got)), 9007199254740992) + 0.5D) / 9007199254740992D)"
        drawn = f"""aggregate(k, named_struct('all', aggregate(k, 0L, (a, b) -> a + b), 'n', aggregate(k, 0L, (a, b) -> a + b) div 2, 'got', CAST(array() AS array<bigint>)),
            (s, g) -> transform(array({_draw("s.all", "g", "s.n", u)}), x -> named_struct('all', s.all - g, 'n', s.n - x, 'got', concat(s.got, array(x))))[0], s -> s.got)"""
        parted = node.withColumn("left", F.expr(drawn)).withColumn("right", F.expr("zip_with(k, left, (a, b) -> a - b)"))
        node = parted.select("names", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("k")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right").alias("k")))).alias("x")).select("x.node", "names", "x.k")
        width //= 2
    flat = node.select("node", F.explode(F.arrays_zip("names", "k")).alias("z")).select(F.col("z.names").alias("skey"), "node", F.col("z.k").alias("n"))
    return flat.groupBy("skey").agg(F.expr("transform(array_sort(collect_list(struct(node, n))), x -> x.n)").alias("by_shard"))


def mix_plan(sized: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each (skey, cell): the shards that draw its block, and the gap if it is the source's last one."""
    cells = storage.materialize(sized.groupBy("skey", "source", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "mix-cells")
    sources = cells.groupBy("skey", "source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    size, target = F.col("source_size"), F.col("target")
    times = F.when(size > 0, F.least(F.lit(MOST), F.floor(target / size + 1e-12))).otherwise(0).cast("int")
    goals = storage.materialize(
        source_targets(sources).withColumn("times", times).withColumn("rest", F.greatest(F.lit(0.0), target - F.col("times") * size)).withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(CELLS), F.floor(F.col("docs") / BLOCK_DOCS)))),
        "mix-goals",
    )
    placed = cells.select("skey", "cell", "words").join(goals.drop("docs"), "skey").withColumn("block", F.floor(F.col("cell") * F.col("blocks") / CELLS).cast("int"))
    blocks = placed.groupBy("skey", "block", "times", "rest").agg(F.sum("words").alias("words"))
    ordered = F.array_sort(F.collect_list(F.struct(F.xxhash64("skey", "block", F.lit(13)).alias("h"), "block", "words")))  # at most CELLS a source
    fitting = "aggregate(o, named_struct('room', rest, 'got', CAST(array() AS array<int>)), (s, x) -> IF(x.words <= s.room, named_struct('room', s.room - x.words, 'got', concat(s.got, array(x.block))), s))"
    rests = blocks.groupBy("skey", "times", "rest").agg(ordered.alias("o")).withColumn("s", F.when(F.col("times") < MOST, F.expr(fitting)))
    rests = rests.select("skey", F.size("o").alias("n"), F.coalesce("s.got", F.array().cast("array<int>")).alias("got"), F.coalesce("s.room", F.lit(0.0)).alias("room"), F.expr("get(filter(o, x -> NOT array_contains(s.got, x.block)), 0).block").alias("edge"))
    decks = storage.materialize(blocks.drop("rest", "words").join(rests.withColumn("parted", F.col("edge").isNotNull() & (F.col("room") > 0)), "skey"), "mix-decks")
    quota = F.max(F.col("times") * F.col("n") + F.size("got") + F.col("parted").cast("int")).cast("long")
    quotas = split_quotas(decks.groupBy("skey").agg(quota.alias("draws")), shards)
    place = F.when(F.col("round") > F.col("times"), F.when(F.col("block") == F.col("edge"), F.size("got") + 1).otherwise(F.nullif(F.array_position("got", F.col("block")), F.lit(0))))
    deck = decks.select("*", F.explode(F.sequence(F.lit(1), F.col("times") + 1)).alias("round")).withColumn("place", place)
    deck = deck.withColumn("nth", F.row_number().over(Window.partitionBy("skey").orderBy("round", F.col("place").asc_nulls_last(), F.xxhash64("skey", "block", "round", F.lit(29)), "block")))
    drawn = deck.join(quotas, "skey").withColumn("shard", F.expr(f"CAST(size(filter(sequence(1, {shards}), j -> aggregate(slice(by_shard, 1, j), 0L, (a, b) -> a + b) < nth)) AS INT)")).filter(F.col("shard") < shards)
    last = F.col("parted") & (F.col("block") == F.col("edge"))
    homes = drawn.groupBy("skey", "block").agg(F.expr("transform(array_sort(collect_list(struct(round, shard))), x -> x.shard)").alias("homes"), F.max(last).alias("last"), F.max(F.when(last, F.col("room"))).alias("gap"))
    cells_of = placed.select("skey", "block", "cell", "source_size", "target")
    full = cells_of.join(homes, ["skey", "block"], "left").withColumn("last", F.coalesce("last", F.lit(False))).withColumn("homes", F.coalesce("homes", F.array().cast("array<int>")))
    return storage.materialize(full, "mix-plan")


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, homes): how often each document is taken, and into which shards."""
    sized = storage.materialize(sized_documents(docs), "mix-sizes")
    plan = mix_plan(sized, shards)
    joined = sized.join(plan, ["skey", "cell"])
    settled = joined.filter(~F.col("last")).withColumn("copies", F.size("homes"))
    by = Window.partitionBy("skey").orderBy(F.xxhash64("doc_id", F.lit(43)), "doc_id", "size")
    edge = joined.filter("last").withColumn("small", F.col("size") <= F.col("gap"))
    edge = edge.withColumn("upto", F.sum(F.when(F.col("small"), F.col("size")).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(by))
    edge = storage.materialize(edge.withColumn("in", F.col("small") & (F.col("upto") <= F.col("gap"))), "mix-edge")
    first = edge.groupBy("skey").agg(F.greatest(F.lit(0), F.coalesce(F.max(F.when(F.col("in"), F.col("at"))), F.lit(0)) - BACK).alias("end"))
    kept = edge.join(first, "skey").withColumn("firm", F.col("small") & (F.col("at") <= F.col("end")))
    used = kept.groupBy("skey").agg(F.coalesce(F.max(F.when(F.col("firm"), F.col("upto"))), F.lit(0)).alias("used"))
    late = kept.filter("small AND NOT firm")
    counts = late.groupBy("skey", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap")).join(used, "skey")
    offers = counts.groupBy("skey").agg((F.first("gap") - F.first("used")).alias("room"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("o"))
    most = "IF(x.size = 0, x.n, least(x.n, CAST(floor(s.room / x.size) AS BIGINT)))"
    fits = offers.select("skey", F.explode(F.expr(f"aggregate(o, named_struct('room', room, 'got', CAST(array() AS array<struct<size:bigint,fit:bigint>>)), (s, x) -> named_struct('room', s.room - {most} * x.size, 'got', concat(s.got, array(named_struct('size', x.size, 'fit', {most})))), s -> s.got)")).alias("g")).select("skey", "g.size", "g.fit")
    nth = late.select("skey", "at", "size", F.row_number().over(Window.partitionBy("skey", "size").orderBy("at")).alias("nth"))
    filled = nth.join(fits, ["skey", "size"]).filter("nth <= fit").select("skey", "at", F.lit(1).alias("fit"))
    more = F.greatest(F.col("firm").cast("int"), F.coalesce("fit", F.lit(0)))
    edges = kept.join(filled, ["skey", "at"], "left").withColumn("copies", F.size("homes") - 1 + more)
    names = ["doc_id", "source", "size", "source_size", "target", "copies", "homes"]
    both = settled.select(*names).unionByName(edges.select(*names))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.slice("homes", F.lit(1), F.col("copies")).alias("homes"))


def mixed_documents(docs: DataFrame, size: int, shards: int = SHARDS) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, by shard, in hash order within each partition.

    Rows are told apart by doc_id, text, source and a hash of all other columns; rows that agree in all of these are
    one row with the draws of all. A shard is spread over several partitions once it is large.
    """
    packed = columns.packed(docs, "doc_id", "text")
    source = F.col(f"{columns.OTHERS}.source")
    named = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))
    tid, rest = F.xxhash64(F.col("text").cast("string")), F.xxhash64(F.to_json(columns.OTHERS))
    key = F.struct(F.col("doc_id").isNull().alias("idless"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.coalesce(tid, F.lit(0)).alias("tid"), named.alias("skey"), rest.alias("rest"))
    taken = mix(packed.select(key.alias("doc_id"), source.alias("source"), "text"), shards)
    draws = taken.filter("copies > 0").select(F.col("doc_id").alias("_key"), F.explode("homes").alias("_shard")).groupBy("_key", "_shard").agg(F.count("*").cast("int").alias("_n"))
    draws = draws.select("_key", "_shard", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    rows = packed.withColumn("_key", key).dropDuplicates(["_key"]).join(draws, "_key")
    n = max(shards, partitions_for(size))
    spread = rows.repartition(n, "_shard", F.pmod(F.xxhash64("_key"), F.lit(max(1, n // shards))))
    return columns.unpacked(spread.sortWithinPartitions("_shard", F.xxhash64("_key", "_copy", "_shard")), docs, "doc_id", "text")


def op7_splitting_tree(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    taken = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "copies", "homes")
