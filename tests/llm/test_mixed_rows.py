"""The rows that the mix returns against what its plan takes of each source."""

from collections import Counter

import pytest

from homelens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return len((text or "").split())


def rows_of(kind):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30 + k % 7))
    rows = [(k, text(k), "en", "b", k) for k in range(900)]
    if kind == "two sources":
        rows += [(k, text(k), "en", "a", k) for k in range(80)] + [(k, text(k), "en", None, k) for k in range(40)]
    if kind == "repeats":
        rows += [(k, text(k), "en", "a", k) for k in range(100)] * 3 + [(7, text(7), "de", "a", 7)] * 5
    if kind == "without ids":
        rows += [(None, text(k % 50), "en", "a", k % 50) for k in range(200)] + [(None, None, None, None, None)] * 9 + [(3, "", "en", "c", 0)]
    return rows


@pytest.mark.parametrize("kind", ["two sources", "repeats", "without ids"])
def test_rows_are_those_that_the_plan_takes(spark, kind):
    docs = spark.createDataFrame(rows_of(kind), SCHEMA).repartition(3)
    plan = mixing.mix(docs).collect()
    target = {r["source"]: r["target"] for r in plan}
    size = {r["source"]: r["source_size"] for r in plan}
    mixed = mixing.mixed_documents(docs, 10_000, 4)
    found = mixed.collect()
    taken = Counter()
    for r in found:
        taken[r["source"]] += words(r["text"])
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 40 and taken[source] <= 3 * size[source], (source, taken[source], goal)
    known = Counter(map(tuple, docs.collect()))
    assert all(n <= 3 * known[row] for row, n in Counter(map(tuple, found)).items())
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, found))
