"""Durable devices from sightings: claims on identifiers, address history, and order-dependent resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homelens.operators import skew

# Confidence of each kind of identifier.
CONFIDENCE = {"mac": 1.0, "controller_id": 1.0, "hostname": 0.5, "dns_client": 0.5, "ip": 0.1}
CONFIRMED = 0.9
STRONG = ("mac", "controller_id")  # in the order in which they are asked


def identifier_claims(sightings: DataFrame) -> DataFrame:
    """(kind, value, device_id, first_seen, last_seen): the first device to show an identifier owns it, and only
    the owner's sightings move its times. ``sightings``: (seq, kind, value, device_id, seen_at)."""
    each = sightings.groupBy("kind", "value", "device_id").agg(F.min("seq").alias("_seq"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    owner = each.groupBy("kind", "value").agg(F.min_by(F.struct("device_id", "first_seen", "last_seen"), "_seq").alias("_o"))
    return owner.select("kind", "value", "_o.*")


def confirm_identifiers(claims: DataFrame, overrides: DataFrame) -> DataFrame:
    """Claims after confirmations (kind, value, device_id, seq): the last one moves a weak identifier; a strong one
    held by another device stays where it is. Adds confidence."""
    last = overrides.groupBy("kind", "value").agg(F.max_by("device_id", "seq").alias("confirmed"))
    strong = F.col("kind").isin(*STRONG)
    known = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    joined = claims.join(last, ["kind", "value"], "full")
    owner = F.when(strong, F.coalesce("device_id", "confirmed")).otherwise(F.coalesce("confirmed", "device_id"))
    weight = F.when(~strong & F.col("confirmed").isNotNull(), CONFIRMED).otherwise(known[F.col("kind")])
    return joined.select("kind", "value", owner.alias("device_id"), weight.cast("decimal(5,4)").alias("confidence"), "first_seen", "last_seen")


def ip_history(sightings: DataFrame, key: str = "device_id") -> DataFrame:
    """(key, ip, observed_from, observed_to): runs of one address; a run ends where the next one starts."""
    order = Window.partitionBy(key).orderBy("observed_at", "id")
    changes = sightings.filter("ip IS NOT NULL").withColumn("before", F.lag("ip").over(order)).filter("before IS NULL OR before <> ip")
    return changes.select(key, "ip", F.col("observed_at").alias("observed_from"), F.lead("observed_at").over(order).alias("observed_to"))


def unknown_flag(identifiers: DataFrame) -> DataFrame:
    """(device_id, is_unknown): whether a device owns no strong identifier."""
    return identifiers.groupBy("device_id").agg((~F.bool_or(F.col("kind").isin(*STRONG))).alias("is_unknown"))


def current_ip(assignments: DataFrame) -> DataFrame:
    return assignments.filter("observed_to IS NULL").groupBy("device_id").agg(F.max_by("ip", F.struct("observed_from", "ip")).alias("ip"))


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with MAC and controller id as names that are never NULL: empty where there is none."""
    return rows.select("*", *[F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("")).alias(f"_{k}") for k in STRONG])


def _followed(links: DataFrame, most: int, hot: int) -> DataFrame:
    """``links`` (seq, up) with ``up`` where the pointers end; each round halves the ways that are left."""
    for _ in range(most):
        onward = links.filter("up <> seq").select(F.col("seq").alias("up"), F.col("up").alias("_next"))
        moved = skew.dealt_join(links.filter("up <> seq"), onward, ["up"], "seq", hot).select("seq", "_next").checkpoint()
        if moved.isEmpty():
            return links
        links = links.join(moved, "seq", "left").withColumn("up", F.coalesce("_next", "up")).drop("_next").checkpoint()
    raise RuntimeError(f"devices did not settle in {most} rounds")


def resolve_batch(observations: DataFrame, claims: DataFrame | None = None, most: int = 64, hot: int = skew.HOT) -> tuple[DataFrame, DataFrame]:
    """(``observations`` with device_seq, claims to append) of a batch (seq, mac, controller_id, ...) that comes after all that
    ``claims`` (kind, value, device_seq) holds.

    A sighting goes to the owner of its MAC, else of its controller id, else it is a new device; identifiers
    stay with their first owner, so devices never merge. An identifier's owner is the device of the first
    sighting that shows it. So only identifiers without a claim and the first sighting of each distinct pair count: it points to
    the first one with its MAC, else with its controller id, if that is earlier, and its device is where the pointers
    end, or the claim found on the way. They are followed by doubling, so a chain of n links takes about log2(n)
    rounds. Sightings without either identifier are devices of their own and skip these steps. ``seq`` is unique in
    a batch and grows from batch to batch.
    """
    held = (lambda k: claims.filter(F.col("kind") == k)) if claims is not None else lambda k: None
    named = _named(observations)
    pairs = named.filter("_mac <> '' OR _controller_id <> ''").groupBy("_mac", "_controller_id").agg(F.min("seq").alias("seq")).checkpoint()
    for key in STRONG:
        have = pairs.filter(f"_{key} <> ''")
        firsts = have.groupBy(f"_{key}").agg(F.min("seq").alias(f"first_{key}"))
        if claims is None:
            firsts = firsts.withColumn(f"owner_{key}", F.lit(None).cast("long"))
        else:
            known = held(key).select(F.concat(F.lit("="), "value").alias(f"_{key}"), F.col("device_seq").alias(f"owner_{key}"))
            firsts = firsts.join(known, f"_{key}", "left")
        none = pairs.filter(f"_{key} = ''").select("*", *[F.lit(None).cast("long").alias(f"{x}_{key}") for x in ("first", "owner")])
        pairs = skew.dealt_join(have, firsts, [f"_{key}"], "seq", hot).select(*none.columns).unionByName(none)
    earlier = lambda key: F.when(F.col(f"first_{key}") < F.col("seq"), F.col(f"first_{key}"))
    by_mac = F.coalesce("owner_mac", earlier("mac"))  # a claim is older than all sightings of the batch
    target = F.coalesce(by_mac, "owner_controller_id", earlier("controller_id"), "seq")
    claimed = F.col("owner_mac").isNotNull() | (by_mac.isNull() & F.col("owner_controller_id").isNotNull())
    linked = pairs.select("seq", "_mac", "_controller_id", F.when(claimed, target).alias("owner"), F.when(claimed, F.col("seq")).otherwise(target).alias("up")).checkpoint()
    ends = _followed(linked.select("seq", "up"), most, hot)
    roots = linked.filter("owner IS NOT NULL").select(F.col("seq").alias("up"), "owner")
    ended = skew.dealt_join(ends, roots, ["up"], "seq", hot, "left").select("seq", F.coalesce("owner", "up").alias("device_seq"))
    found = linked.select("seq", "_mac", "_controller_id").join(ended, "seq").drop("seq").checkpoint()
    paired, lone = named.filter("_mac <> '' OR _controller_id <> ''"), observations.filter("mac IS NULL AND controller_id IS NULL")
    owned = skew.dealt_join(paired, found, ["_mac", "_controller_id"], "seq", hot).select(*observations.columns, "device_seq")
    out = owned.unionByName(lone.withColumn("device_seq", F.col("seq")))
    fresh = None
    for key in STRONG:
        first = linked.join(ended, "seq").filter(f"_{key} <> ''").groupBy(f"_{key}").agg(F.min_by("device_seq", "seq").alias("device_seq"))
        new = first.select(F.lit(key).alias("kind"), F.substring(f"_{key}", 2, 2**31 - 1).alias("value"), "device_seq")
        new = new if claims is None else new.join(held(key).select("value"), "value", "left_anti")
        fresh = new if fresh is None else fresh.unionByName(new)
    return out, fresh


def resolve_devices(observations: DataFrame, most: int = 64) -> DataFrame:
    """``observations`` (seq, mac, controller_id, ...) with the device each belongs to; see ``resolve_batch``."""
    return resolve_batch(observations, None, most)[0]


def new_devices(resolved: DataFrame) -> DataFrame:
    """(device_seq, kind, is_unknown): an event for each sighting of ``resolve_batch`` that made a device of its own."""
    own = resolved.filter(F.col("seq") == F.col("device_seq"))
    return own.select("device_seq", F.lit("new_device").alias("kind"), (F.col("mac").isNull() & F.col("controller_id").isNull()).alias("is_unknown"))
