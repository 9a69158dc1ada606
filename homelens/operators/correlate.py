"""Attribution of DNS queries to devices from address and name evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homelens.operators import skew

# Weight of each kind of evidence, boosts for agreeing kinds, cap and threshold.
IP, CLIENT, HOSTNAME = 0.80, 0.60, 0.55
IP_CLIENT, IP_HOSTNAME = 0.15, 0.10
CAP, THRESHOLD = 0.99, 0.70
WIDTH = 86400
SLOT = 3600
# Of jobs that give many more pairs than they read rows: queries in a run, tasks, and the pairs that one task may have of a value.
RUN, TASKS, PAIRS = 512, 240, 10_000_000


def windowed(queries: DataFrame, width: int = WIDTH) -> DataFrame:
    """``queries`` with the number of the window of ``width`` seconds that holds queried_at."""
    return queries.withColumn("window", F.floor(F.unix_micros(F.col("queried_at").cast("timestamp")) / (width * 1_000_000)))


def binned(assignments: DataFrame, queries: DataFrame, width: int = WIDTH) -> DataFrame:
    """Assignments once for each window that they overlap, among the windows from the first query to the last."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    size = width * 1_000_000
    ends = windowed(queries, width).agg(F.min("window").alias("_first"), F.max("window").alias("_last"))
    spans = assignments.select("ip", "device_id", "observed_from", "observed_to").crossJoin(F.broadcast(ends))  # one row
    low = F.greatest("_first", F.floor(micros("observed_from") / size))
    high = F.least("_last", F.coalesce(F.ceil(micros("observed_to") / size) - 1, F.col("_last")))
    return spans.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high").select("ip", "device_id", "observed_from", "observed_to", F.explode(F.sequence("_low", "_high")).alias("window"))


def interval_join(queries: DataFrame, assignments: DataFrame, width: int = WIDTH, hot: int = skew.HOT) -> DataFrame:
    """(id, device_id, queried_at) of assignments whose half-open span holds the query.

    Spans are cut by windows of ``width`` seconds and meet the queries of the same address and window, so a query is
    compared only with the spans of its own window; addresses that are hot in a window are dealt over several tasks.
    """
    covers = (F.col("observed_from") <= F.col("queried_at")) & (F.col("observed_to").isNull() | (F.col("observed_to") > F.col("queried_at")))
    asked = windowed(queries.select("id", "ip", "queried_at"), width).filter("ip IS NOT NULL")
    return skew.dealt_join(asked, binned(assignments, queries, width), ["ip", "window"], "id", hot).filter(covers).select("id", "device_id", "queried_at")


def candidate_pairs(queries: DataFrame, assignments: DataFrame, width: int = WIDTH) -> DataFrame:
    """(ip, pairs, whole): how many pairs of a query and a span each address compares by windows, and would without them."""
    asked = windowed(queries, width).groupBy("ip", "window").agg(F.count("*").alias("q"))
    spans = binned(assignments, queries, width).groupBy("ip", "window").agg(F.count("*").alias("s"))
    pairs = asked.join(spans, ["ip", "window"]).groupBy("ip").agg(F.sum(F.col("q") * F.col("s")).alias("pairs"))
    whole = queries.groupBy("ip").agg(F.count("*").alias("q")).join(assignments.groupBy("ip").agg(F.count("*").alias("s")), "ip")
    return whole.join(pairs, "ip", "left").select("ip", F.coalesce("pairs", F.lit(0)).alias("pairs"), (F.col("q") * F.col("s")).alias("whole"))


def identifier_join(queries: DataFrame, identifiers: DataFrame, hot: int = skew.HOT) -> DataFrame:
    """(id, device_id, kind) of name evidence: identifiers with the client's value, valid since they were first seen.

    A value has one owner of each kind; clients that a great many queries name are dealt over several tasks.
    """
    names = identifiers.filter(F.col("kind").isin("dns_client", "hostname")).select(F.col("value").alias("_value"), "kind", "device_id", "first_seen")
    asked = queries.select("id", "queried_at", F.trim("client").alias("_value")).filter("_value <> ''")
    return skew.dealt_join(asked, names, ["_value"], "id", hot).filter("first_seen <= queried_at").select("id", "device_id", "kind")


def in_runs(queries: DataFrame, held: DataFrame, keys: list[str], since: str, until: str | None = None, run: int = RUN, tasks: int = TASKS) -> DataFrame:
    """Pairs of ``queries`` and ``held`` with equal ``keys``, the query at ``since`` or later and before ``until`` (null: no end); queries as _q.

    Queries of a key travel in runs of ``run``, in the order of their times. A run meets each row held once and is unfolded there, so what is
    moved are rows, and pairs come a run at a time: writers keep equal values and repeated runs in few bytes. Pairs
    outgrow what is read, so the number of tasks is given, not derived from bytes.
    """
    order = Window.partitionBy(*keys).orderBy("queried_at")
    others = [c for c in queries.columns if c not in keys]
    cut = queries.repartition(tasks, *keys).withColumn("_cut", F.floor((F.row_number().over(order) - 1) / run))
    runs = cut.groupBy(*keys, "_cut").agg(F.collect_list(F.struct(*others)).alias("_run"), F.min("queried_at").alias("_first"), F.max("queried_at").alias("_last"))
    within = lambda low, high: (F.col(since) <= high) & (F.lit(True) if until is None else F.col(until).isNull() | (F.col(until) > low))
    met = runs.join(held.repartition(tasks, *keys), keys).filter(within(F.col("_first"), F.col("_last")))
    at = F.col("_q.queried_at")
    return met.select(*held.columns, F.explode("_run").alias("_q")).filter(within(at, at))


def crowded_join(queries: DataFrame, identifiers: DataFrame, run: int = RUN, tasks: int = TASKS, most: int = PAIRS) -> DataFrame:
    """What ``identifier_join`` gives, for values that many devices show: pairs are made run by run where they are given.

    Values with more than ``most`` pairs and a 1,000th of all are dealt over tasks, each of which gets all devices that show the value.
    """
    names = identifiers.filter(F.col("kind").isin("dns_client", "hostname")).select(F.col("value").alias("_value"), "kind", "device_id", "first_seen")
    asked = queries.select("id", "queried_at", F.trim("client").alias("_value")).filter("_value <> ''")
    count = F.count(F.lit(1))
    pairs = asked.groupBy("_value").agg(count.alias("_n")).join(names.groupBy("_value").agg(count.alias("_d")), "_value").select("_value", (F.col("_n") * F.col("_d")).alias("_pairs"))
    least = F.greatest(F.lit(float(most)), F.sum("_pairs") / 1000).alias("_least")
    many = pairs.crossJoin(F.broadcast(pairs.agg(least))).filter("_pairs > _least")  # one row
    some = F.broadcast(many.select("_value", F.ceil(F.col("_pairs") / F.col("_least")).cast("int").alias("_shares")))  # 1,000 at most
    shares = F.coalesce("_shares", F.lit(1))
    left = asked.join(some, "_value", "left").withColumn("_share", F.pmod(F.xxhash64("id"), shares).cast("int")).drop("_shares")
    right = names.join(some, "_value", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return in_runs(left, right, ["_value", "_share"], "first_seen", None, run, tasks).select("_q.id", "device_id", "kind")


def shared_spans(assignments: DataFrame) -> DataFrame:
    """The spans of addresses that more than one device held at some time."""
    shared = assignments.groupBy("ip").agg(F.min("device_id").alias("_least"), F.max("device_id").alias("_most")).filter("_least < _most").select("ip")
    return assignments.join(shared, "ip", "left_semi")


def reassigned_addresses(queries: DataFrame, assignments: DataFrame, width: int = WIDTH) -> DataFrame:
    """(ip, window): addresses that more than one device held within a window of ``width`` seconds."""
    held = binned(shared_spans(assignments), queries, width).groupBy("ip", "window").agg(F.min("device_id").alias("_least"), F.max("device_id").alias("_most"))
    return held.filter("_least < _most").select("ip", "window")


def merged_spans(assignments: DataFrame) -> DataFrame:
    """``assignments`` that hold some time, those of one device and address that overlap or touch as one span."""
    order = Window.partitionBy("ip", "device_id").orderBy("observed_from", "_end")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    open_end = F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")
    spans = assignments.select("ip", "device_id", "observed_from", F.coalesce("observed_to", open_end).alias("_end")).filter("ip IS NOT NULL AND observed_from < _end")
    runs = spans.withColumn("_new", F.coalesce(F.col("observed_from") > before, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("ip", "device_id", "_run").agg(F.min("observed_from").alias("observed_from"), F.max("_end").alias("_end"))
    return merged.select("ip", "device_id", "observed_from", F.nullif("_end", open_end).alias("observed_to"))


def _slot(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))


def holders(queries: DataFrame, spans: DataFrame, seconds: int = SLOT) -> DataFrame:
    """``queries`` with by_ip (a span holds the query), holders (how many devices do) and holder (the only one).

    ``spans`` as ``merged_spans`` gives them. Nothing is paired: starts, ends and queries of an address are swept in the order of their
    times, a slot of ``seconds`` at a time; a slot begins with the sums of all slots before it. At one time spans begin and end before a query.
    """
    asked = [F.col(f"`{c}`") for c in queries.columns]
    change = lambda at, sign: spans.filter(F.col(at).isNotNull()).select("ip", F.col(at).alias("_at"), F.lit(sign).alias("_any"), F.when(F.col("device_id").isNotNull(), sign).otherwise(0).alias("_n"), F.coalesce(F.col("device_id").cast("long"), F.lit(0)).alias("_x"))
    moves = change("observed_from", 1).unionByName(change("observed_to", -1)).withColumn("_slot", _slot("_at", seconds))
    sums = lambda over=None: [f.over(over).alias(n) if over else f.alias(n) for n, f in (("_any", F.sum("_any")), ("_n", F.sum("_n")), ("_x", F.bit_xor("_x")))]
    row = F.struct(*asked)
    rows = queries.select("ip", F.col("queried_at").alias("_at"), row.alias("_q"), F.lit(0).alias("_any"), F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_x")).withColumn("_slot", _slot("_at", seconds))
    nets = moves.groupBy("ip", "_slot").agg(*sums())
    wanted = rows.filter("ip IS NOT NULL").select("ip", "_slot").distinct().select("*", F.lit(0).cast("long").alias("_any"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_x"))
    slots = nets.unionByName(wanted).groupBy("ip", "_slot").agg(*sums())
    before = Window.partitionBy("ip").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("ip", "_slot", *sums(before)).filter("_any IS NOT NULL")
    every = rows.unionByName(moves, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # sums carried over have no time and no query, so they come first; a query comes after all that happens at its time
    upto = Window.partitionBy("ip", "_slot").orderBy(F.col("_at").asc_nulls_first(), F.col("_q").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = every.select("ip", "_q", *sums(upto)).filter("_q IS NOT NULL")
    known = F.col("ip").isNotNull()
    return swept.select("_q.*", (known & (F.col("_any") > 0)).alias("by_ip"), F.when(known, F.col("_n")).otherwise(0).cast("long").alias("holders"), F.when(known & (F.col("_n") == 1), F.col("_x")).alias("holder"))


def ip_reassignment(assignments: DataFrame, start: Column, end: Column) -> DataFrame:
    """(ip, devices) held by more than one device within the window."""
    overlaps = (F.col("observed_from") <= end) & (F.col("observed_to").isNull() | (F.col("observed_to") > start))
    return assignments.filter(overlaps).groupBy("ip").agg(F.count_distinct("device_id").alias("devices")).filter("devices > 1")


def confidence_score(ip: Column, client: Column, hostname: Column) -> Column:
    """Score of one candidate from the kinds of evidence that name it."""
    best = F.when(ip, IP).when(client, CLIENT).when(hostname, HOSTNAME).otherwise(0.0)
    boosted = F.greatest(best, F.when(ip & client, IP + IP_CLIENT).otherwise(0.0), F.when(ip & hostname, IP + IP_HOSTNAME).otherwise(0.0))
    return F.least(F.lit(CAP), F.round(boosted, 4)).cast("decimal(5,4)")


def _decided(rows: DataFrame, conflict: Column, by_ip: Column, by_client: Column, by_name: Column, threshold: float) -> DataFrame:
    """``rows``, where ``only`` is the lone candidate, with status, device_id, confidence and needs_review."""
    score = confidence_score(*[F.coalesce(k, F.lit(False)) for k in (by_ip, by_client, by_name)])
    scored = rows.withColumn("confidence", F.when(conflict, F.lit(0)).otherwise(score).cast("decimal(5,4)"))
    status = F.when(conflict, "ambiguous").when(F.col("only").isNotNull() & (F.col("confidence") >= threshold), "attributed").otherwise("unattributed")
    return scored.withColumn("status", status).withColumn("device_id", F.when(F.col("status") == "attributed", F.col("only"))).withColumn("needs_review", F.col("status") != "attributed")


def _weight(kind: Column) -> Column:
    return F.when(kind == "ip", IP).when(kind == "dns_client", CLIENT).otherwise(HOSTNAME).cast("decimal(5,4)")


def _conflicts(moved: Column, several: Column) -> Column:
    """Records (reason, device_ids, match_kinds) of what blocks attribution, from the columns candidates and evidence."""
    kinds = F.array_distinct(F.transform("evidence", lambda e: e["kind"]))
    record = lambda reason: F.struct(F.lit(reason).alias("reason"), F.coalesce("candidates", F.array()).alias("device_ids"), F.coalesce(kinds, F.array()).alias("match_kinds"))
    return F.concat(F.when(moved, F.array(record("ip_reassigned_in_window"))).otherwise(F.array()), F.when(several, F.array(record("multiple_candidate_devices"))).otherwise(F.array()))


def attribution(queries: DataFrame, evidence: DataFrame, reassigned: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, status, device_id, confidence, needs_review, candidates, evidence, conflicts) of every query (id, ip, ...).

    ``evidence``: (id, device_id, kind in ip, dns_client, hostname). Several candidate devices, or an address in
    ``reassigned`` (ip, or ip and the query's window), make a query ambiguous with score 0; one candidate below the threshold keeps
    its score but stays unattributed. ``evidence`` holds each match with its weight, ``conflicts`` a record (reason,
    device_ids, match_kinds) of all that blocks attribution, the address first.
    """
    has = lambda k: F.bool_or(F.col("kind") == k)
    match = F.struct("kind", "device_id", _weight(F.col("kind")).alias("weight"))
    summed = evidence.groupBy("id").agg(F.min("device_id").alias("only"), F.array_sort(F.collect_set("device_id")).alias("candidates"), F.array_sort(F.collect_set(match)).alias("evidence"), has("ip").alias("by_ip"), has("dns_client").alias("by_client"), has("hostname").alias("by_name"))
    where = ["ip", "window"] if reassigned is not None and "window" in reassigned.columns else ["ip"]
    joined = queries.select("id", *where).join(summed, "id", "left")
    if reassigned is None:
        joined = joined.withColumn("moved", F.lit(False))
    else:
        joined = joined.join(reassigned.select(*where).distinct().withColumn("moved", F.lit(True)), where, "left")
    moved, several = F.coalesce("moved", F.lit(False)), F.coalesce(F.size("candidates") > 1, F.lit(False))
    out = _decided(joined, moved | several, F.col("by_ip"), F.col("by_client"), F.col("by_name"), threshold)
    lists = [F.coalesce(c, F.array()).alias(c) for c in ("candidates", "evidence")]
    return out.select("id", "status", "device_id", "confidence", "needs_review", *lists, _conflicts(moved, several).alias("conflicts"))


def verdicts(queries: DataFrame, spans: DataFrame, named: DataFrame | None, reassigned: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """What ``attribution`` decides, without the lists: ``queries`` with status, device_id, confidence and needs_review.

    ``spans`` as ``merged_spans`` gives them, ``named``: (id, device_id, kind) by name, ``reassigned``: (ip, window). The devices of a query are
    counted, not paired with it, so the work grows with the rows. Also kept: moved, several, by_ip, holder, and names, the evidence by name.
    """
    held = holders(queries, spans)
    if named is None:
        kind = f"array<struct<kind:string,device_id:{spans.schema['device_id'].dataType.simpleString()}>>"
        none = lambda c, n: F.lit(None).cast(c).alias(n)
        held = held.select("*", none("long", "_least"), none("long", "_most"), none(kind, "names"), none("boolean", "by_client"), none("boolean", "by_name"))
    else:
        has = lambda k: F.bool_or(F.col("kind") == k)
        each = named.groupBy("id").agg(F.min("device_id").alias("_least"), F.max("device_id").alias("_most"), F.collect_set(F.struct("kind", "device_id")).alias("names"), has("dns_client").alias("by_client"), has("hostname").alias("by_name"))
        held = held.join(each, "id", "left")
    if reassigned is None:
        held = held.withColumn("moved", F.lit(False))
    else:
        held = held.join(reassigned.select("ip", "window").distinct().withColumn("moved", F.lit(True)), ["ip", "window"], "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    several = (F.col("holders") > 1) | F.coalesce(F.col("_least") < F.col("_most"), F.lit(False)) | F.coalesce(F.col("holder") != F.col("_least"), F.lit(False))
    lone = held.withColumn("several", several).withColumn("only", F.coalesce("holder", "_least"))
    out = _decided(lone, F.col("moved") | F.col("several"), F.col("by_ip"), F.col("by_client"), F.col("by_name"), threshold)
    kept = [f"`{c}`" for c in queries.columns]
    return out.select(*kept, "status", "device_id", "confidence", "needs_review", "moved", "several", "by_ip", "holders", "holder", "names")


def held_runs(rows: DataFrame, spans: DataFrame, item: Column, seconds: int = SLOT) -> DataFrame:
    """(ip, _slot, _runs): what holds each shared address in a slot of ``seconds``, as ``item`` of the spans, by device_id.

    A run (_n, changed, item, rest) begins with a span that starts or ends within the slot, to be asked for each query, and goes on with
    those that hold all of it, which need not be asked. The first run has no such span if the slot begins with others.
    """
    ends = rows.agg(F.min("queried_at").alias("_first"), F.max("queried_at").alias("_last"))
    some = shared_spans(spans).crossJoin(F.broadcast(ends)).filter("observed_from <= _last AND (observed_to IS NULL OR observed_to > _first)")  # one row
    until = F.least(F.coalesce(F.col("observed_to") - F.expr("INTERVAL 1 MICROSECOND"), F.col("_last")), F.col("_last"))
    cut = some.withColumn("_low", F.greatest("observed_from", "_first")).withColumn("_high", until)
    slots = cut.withColumn("_slot", F.explode(F.sequence(_slot("_low", seconds), _slot("_high", seconds)))).drop("_first", "_last", "_low", "_high")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    size = seconds * 1_000_000
    whole = (micros("observed_from") <= F.col("_slot") * size) & (F.col("observed_to").isNull() | (micros("observed_to") >= (F.col("_slot") + 1) * size))
    order = Window.partitionBy("ip", "_slot").orderBy("device_id", "observed_from")
    told = slots.withColumn("_whole", whole).withColumn("_n", F.sum((~F.col("_whole")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.first(F.when(~F.col("_whole"), F.struct("observed_from", "observed_to")), ignorenulls=True).alias("changed")
    rest = F.collect_list(F.when(F.col("_whole"), F.struct("device_id", item.alias("item"))))
    runs = told.groupBy("ip", "_slot", "_n").agg(changed, F.first(F.when(~F.col("_whole"), F.struct(item.alias("item"))), ignorenulls=True).alias("_own"), F.sort_array(rest).alias("_rest"))
    run = F.struct("_n", "changed", F.col("_own.item").alias("item"), F.transform("_rest", lambda x: x["item"]).alias("rest"))
    return runs.groupBy("ip", "_slot").agg(F.sort_array(F.collect_list(run)).alias("_runs"))


def _met(rows: DataFrame, runs: DataFrame, lone: Column, seconds: int) -> DataFrame:
    """``rows`` with held: the items of ``runs`` that hold the query, or ``lone`` where an address has one device only."""
    covers = lambda x: (x["changed"]["observed_from"] <= F.col("queried_at")) & (x["changed"]["observed_to"].isNull() | (x["changed"]["observed_to"] > F.col("queried_at")))
    found = F.flatten(F.flatten(F.transform("_runs", lambda x: F.array(F.when(covers(x), F.array(x["item"])).otherwise(F.array()), x["rest"]))))
    met = rows.withColumn("_slot", _slot("queried_at", seconds)).join(runs, ["ip", "_slot"], "left")
    return met.withColumn("held", F.coalesce(found, F.when(F.col("by_ip"), F.array(lone)), F.array())).drop("_slot", "_runs")


def with_holders(rows: DataFrame, spans: DataFrame, seconds: int = SLOT, also: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` of ``verdicts`` with held: (device_id, and the columns ``also`` of ``spans``) by device_id, all devices whose spans hold the query.

    Queries of shared addresses meet one array for each address and slot, about as long as what they give; it is cut down in
    place, so pairs are never moved. Where an address has one device only, held is what ``verdicts`` found, without ``also``.
    """
    kinds = {f.name: f.dataType for f in spans.schema.fields}
    lone = F.struct(F.col("holder").cast(kinds["device_id"]).alias("device_id"), *[F.lit(None).cast(kinds[c]).alias(c) for c in also])
    return _met(rows, held_runs(rows, spans, F.struct("device_id", *also), seconds), lone, seconds)


def with_text(rows: DataFrame, spans: DataFrame, seconds: int = SLOT) -> DataFrame:
    """``rows`` of ``verdicts`` with evidence as one text of kind:device_id, joined by commas in the order of both.

    What holds an address for a whole slot is joined once for the slot, so a query costs what changes within its slot and the bytes it gives.
    """
    match = lambda kind, device: F.concat(kind, F.lit(":"), device.cast("string"))
    runs = held_runs(rows, spans, match(F.lit("ip"), F.col("device_id")), seconds)
    known = lambda run: F.filter(run, lambda e: e.isNotNull())
    joined = lambda run: F.when(F.size(run) > 0, F.array(F.array_join(run, ","))).otherwise(F.array())
    packed = runs.withColumn("_runs", F.transform("_runs", lambda x: F.struct(x["changed"].alias("changed"), x["item"].alias("item"), joined(known(x["rest"])).alias("rest"))))
    by_name = F.transform(F.sort_array(F.coalesce("names", F.array())), lambda e: match(e["kind"], e["device_id"]))
    met = _met(rows, packed, match(F.lit("ip"), F.col("holder")), seconds)
    return met.withColumn("evidence", F.concat_ws(",", by_name, "held")).drop("held", "names")


def listed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` of ``verdicts`` with candidates, evidence and conflicts, as ``attribution`` gives them."""
    names = F.coalesce("names", F.array())
    match = lambda kind, device: F.struct(kind.alias("kind"), device.alias("device_id"), _weight(kind).alias("weight"))
    by_name = F.sort_array(F.transform(names, lambda e: match(e["kind"], e["device_id"])))
    by_ip = F.transform("held", lambda e: match(F.lit("ip"), e["device_id"]))  # the last of the kinds, and sorted
    devices = F.concat(F.transform("held", lambda e: e["device_id"]), F.transform(names, lambda e: e["device_id"]))
    lists = with_holders(rows, spans).withColumn("evidence", F.concat(by_name, by_ip)).withColumn("candidates", F.array_sort(F.array_distinct(F.array_compact(devices))))
    return lists.withColumn("conflicts", _conflicts(F.col("moved"), F.col("several"))).drop("held", "names")


def review_queue(activity: DataFrame) -> DataFrame:
    return activity.filter(F.col("needs_review") & F.col("status").isin("ambiguous", "unattributed"))


def review_candidates(queue: DataFrame, devices: DataFrame) -> DataFrame:
    """(id, device_id, display_name) of every device that evidence or a conflict of a queued row names."""
    named = F.concat("candidates", F.flatten(F.transform("conflicts", lambda c: c["device_ids"])))
    return queue.select("id", F.explode(F.array_distinct(named)).alias("device_id")).join(devices.select("device_id", "display_name"), "device_id", "left")


def queued_candidates(queue: DataFrame, spans: DataFrame, devices: DataFrame, width: int = WIDTH, run: int = RUN, tasks: int = TASKS) -> DataFrame:
    """What ``review_candidates`` gives, for queued rows of ``verdicts``. Spans of shared addresses carry the names of their
    devices and meet runs of queries of the same address and window, so the many candidates are given a device at a time and not joined one by one."""
    told = devices.select("device_id", "display_name")
    by_name = F.transform(F.coalesce("names", F.array()), lambda e: e["device_id"])
    few = queue.select("id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("holder"), by_name)))).alias("device_id")).join(told, "device_id", "left")
    asked = windowed(queue.filter("holders > 1").select("id", "ip", "queried_at", by_name.alias("_known")), width)
    named = binned(shared_spans(spans).filter("device_id IS NOT NULL"), asked, width).join(told, "device_id", "left")
    many = in_runs(asked, named, ["ip", "window"], "observed_from", "observed_to", run, tasks).filter("NOT array_contains(_q._known, device_id)")
    return few.select("id", "device_id", "display_name").unionByName(many.select("_q.id", "device_id", "display_name"))
