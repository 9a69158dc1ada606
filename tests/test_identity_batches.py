"""Devices resolved batch by batch against a replay one sighting at a time."""

import random

import pytest

from homelens.operators import identity

SCHEMA = "seq long, mac string, controller_id string, note string"


def replay(rows):
    """Device of each sighting and the owners of all identifiers, in order of arrival."""
    owner, device = {}, {}
    for seq, mac, other, _ in rows:
        own = owner.get(("mac", mac)) if mac is not None else None
        if own is None and other is not None:
            own = owner.get(("controller_id", other))
        device[seq] = seq if own is None else own
        for key in (("mac", mac), ("controller_id", other)):
            if key[1] is not None:
                owner.setdefault(key, device[seq])
    return device, owner


def drawn(seed, n):
    draw = random.Random(seed)
    pick = lambda kind, k: draw.choice([None, "", "hot"] + [f"{kind}{draw.randrange(k)}"] * 6)
    return [(i, pick("m", 25), pick("u", 25), "x") for i in range(n)]


@pytest.mark.parametrize("seed, cuts, hot", [(1, [0, 200], 10**6), (2, [0, 90, 150, 200], 10), (3, [0, 1, 2, 120, 200], 10**6)])
def test_batches_give_what_one_replay_gives(spark, seed, cuts, hot):
    rows = drawn(seed, 200)
    device, owner = replay(rows)
    claims, found = None, {}
    for low, high in zip(cuts, cuts[1:]):
        batch = spark.createDataFrame(rows[low:high], SCHEMA).repartition(3)
        out, fresh = identity.resolve_batch(batch, claims, hot=hot)
        assert out.columns == ["seq", "mac", "controller_id", "note", "device_seq"]
        found |= {r["seq"]: r["device_seq"] for r in out.collect()}
        claims = (fresh if claims is None else claims.unionByName(fresh)).checkpoint()
    assert found == device
    assert {(r["kind"], r["value"]): r["device_seq"] for r in claims.collect()} == owner


def test_a_chain_over_two_batches(spark):
    chain = [(2 * k, f"m{k}", f"u{k}", "") for k in range(20)] + [(2 * k + 1, f"m{k + 1}", f"u{k}", "") for k in range(19)]
    rows = sorted(chain)
    device, _ = replay(rows)
    early, claims = identity.resolve_batch(spark.createDataFrame(rows[:15], SCHEMA))
    claims = claims.checkpoint()
    late, fresh = identity.resolve_batch(spark.createDataFrame(rows[15:], SCHEMA), claims)
    assert {r["seq"]: r["device_seq"] for r in early.unionByName(late).collect()} == device
    assert not set(map(tuple, claims.select("kind", "value").collect())) & set(map(tuple, fresh.select("kind", "value").collect()))


def test_no_sightings(spark):
    out, fresh = identity.resolve_batch(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and fresh.collect() == []
