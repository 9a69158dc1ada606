"""Links of vectors against all cosines: several parts and cells, one dense group, and pairs at the threshold."""

import numpy as np
import pytest

from homelens.llm import neardup


def brute(x, threshold=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    count, label = np.zeros(len(x), int), np.arange(len(x))
    i, j = [], []
    for k in range(0, len(x), 512):
        a, b = np.nonzero(unit[k : k + 512] @ unit.T >= threshold)
        keep = a + k != b
        i.append(a[keep] + k)
        j.append(b[keep])
    i, j = np.concatenate(i), np.concatenate(j)
    count = np.bincount(i, minlength=len(x))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        if (low == label).all():
            return count, label
        label = low


def found(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows = neardup.linked_vectors(df).collect()
    assert len(rows) == len(x) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    by = {r["vec_id"]: r for r in rows}
    return [by[i]["n_links"] for i in range(len(x))], [by[i]["component_id"] for i in range(len(x))]


@pytest.mark.parametrize("kind", ["spread", "parted"])
def test_many_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(neardup, "GROUP", 900)
    draw = np.random.default_rng(8)
    base = draw.normal(size=(700, 20))
    if kind == "parted":  # far clusters along the leading axes, so that these are cut
        base = base * 0.25 + np.repeat(np.eye(20)[:4] * 4, 175, 0)
    x = base[draw.integers(0, 700, 4000)] + draw.normal(size=(4000, 20)) * 0.12
    count, label = brute(x)
    assert found(spark, x) == (count.tolist(), label.tolist())
    assert len(set(label.tolist())) >= 4


def test_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 2000)
    draw = np.random.default_rng(9)
    x = np.concatenate([draw.normal(size=(1, 8)) + draw.normal(size=(5000, 8)) * 0.02, draw.normal(size=(200, 8))])
    count, label = brute(x)
    assert found(spark, x) == (count.tolist(), label.tolist()) and count.max() > 4900


def test_cosines_at_the_threshold(spark):
    rows = [[20.0, 0.0, 0.0], [19.0, 39.0**0.5, 0.0], [95.0, 0.0, 975.0**0.5], [0.0, 1.0, 0.0], [19.0 - 1e-7, 39.0**0.5, 0.0], [19.0 + 1e-7, -(39.0**0.5), 0.0]]
    x = np.array(rows)
    want = [(a, b) for a in range(6) for b in range(6) if a != b and (x[a] * x[b]).sum() / (np.sqrt((x[a] ** 2).sum()) * np.sqrt((x[b] ** 2).sum())) >= 0.95]
    assert found(spark, x)[0] == [sum(a == i for a, _ in want) for i in range(6)]


def test_labels_follow_chains():
    label = neardup._join_labels(np.arange(10), np.array([8, 3, 5, 7]), np.array([3, 1, 7, 8]))
    assert label.tolist() == [0, 1, 2, 1, 4, 1, 6, 1, 1, 9]
