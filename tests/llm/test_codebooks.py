"""Integer codebooks against a plain version: nulls, ties, repeats, large numbers, few vectors, hot labels."""

import hashlib
import math
import random
from collections import Counter

import pytest

from homelens.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label string, part int, code int"


def plain(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // 16))
    cut = []
    for _, vector, _ in kept:
        whole = [min(2**62, max(-(2**62), math.floor(256 * x))) for x in vector] + [0] * (16 * width - len(vector))
        cut.append([whole[k * width : (k + 1) * width] for k in range(16)])
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:64]
    books = [[list(cut[i][k]) for i in first] for k in range(16)]

    def nearest(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[k]))

    for _ in range(2):
        for k in range(16):
            members = {}
            for vector in cut:
                members.setdefault(nearest(k, vector[k])[1], []).append(vector[k])
            for e, some in members.items():
                books[k][e] = [sum(x) // len(some) for x in zip(*some)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = [(r[0], r[2], [nearest(k, v[k]) for k in range(16)]) for r, v in zip(kept, cut)]
    errors = Counter()
    for _, label, found in coded:
        errors[label] += sum(d for d, _ in found)
    most = 2**63 - 1
    return Counter((i, "".join(f"{e:02x}" for _, e in found), min(most, sum(d for d, _ in found)), min(most, sum(min(most, sum(d for d, _ in f)) for _, n, f in coded if n == label)), digest) for i, label, found in coded)


def hard_rows(n, scale, seed):
    draw = random.Random(seed)
    vector = lambda size=32: [draw.choice((-1, 1)) * draw.random() * scale for _ in range(size)]
    rows = [(i, vector(), f"l{i % 3}" if i % 4 else None) for i in range(n)]
    rows += [(n + 1, None, "l1"), (n + 2, [None] * 32, "l1"), (n + 3, [float("nan")] + [0.0] * 31, None), (n + 4, [float("inf")] * 32, "l2"), (n + 5, [], "l2"), (n + 6, [0.0] * 32, "l2"), (n + 7, vector(20), None)]
    return [*rows, rows[0], rows[0], (None, vector(), "l1"), (3, vector(), "l0"), (n + 8, rows[1][1], "l9")]


@pytest.mark.parametrize("n, scale, hot", [(150, 1.0, 1000), (90, 3.0, 10), (20, 1e12, 10), (10, 1e300, 1000)])
def test_codes_of_hard_rows(spark, monkeypatch, n, scale, hot):
    monkeypatch.setattr(codebooks, "HOT", hot)
    monkeypatch.setattr(codebooks, "STEP", 37)
    rows = hard_rows(n, scale, n)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(4)
    coded, books = codebooks.compress(table)
    found = codebooks.label_totals(coded).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], codebooks.digest(books)) for r in found) == plain(rows)


def test_no_vectors(spark):
    for rows in ([], [(1, None, "a", 0, 0)]):
        coded, books = codebooks.compress(spark.createDataFrame(rows, SCHEMA))
        assert codebooks.label_totals(coded).collect() == [] and books.size == 0
