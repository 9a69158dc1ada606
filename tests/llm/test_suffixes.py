"""Removal of repeated 200-byte strings against brute force: periodic, long, short and repeated texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from homelens.llm import suffixes


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()


def hard_texts():
    draw = random.Random(5)
    noise = lambda n, letters="abcdefgh ": "".join(draw.choices(letters, k=n))
    passage, other = noise(260), noise(199)
    texts = ["a" * 199, "a" * 200, "b" * 201, "ab" * 150, "abc" * 300, "xyz" * 66 + "xy", "q" * 1000, noise(150), "", None, "é" * 130, "日本語" * 40]
    texts += [noise(draw.randrange(1, 300)) + passage + noise(draw.randrange(1, 300)) for _ in range(12)]
    texts += [noise(100) + other + noise(100) for _ in range(4)]
    base = noise(2500)
    for _ in range(8):
        copy = list(base)
        for _ in range(draw.randrange(0, 6)):
            copy[draw.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    texts += [base, base, base[300:900], base[:450] + base[2000:], passage[:200], passage[60:], passage[:199], "01" * 700 + passage, noise(30) * 40, noise(137) * 9, noise(201) * 3]
    return texts


@pytest.mark.parametrize("window", [200, 65, 128, 333])
def test_repeats_of_hard_texts(spark, window):
    texts = hard_texts()
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, block string, at int").repartition(3)
    found = suffixes.remove_repeats(docs, window, piece=700)
    assert Counter(tuple(r) for r in found.drop("kept").collect()) == Counter((i if i % 7 else None, *x) for i, x in enumerate(brute(texts, window)))


def test_repeats_of_many_copies_of_one_row(spark):
    draw = random.Random(6)
    text = "".join(draw.choices("abcdef", k=700))
    docs = spark.createDataFrame([(1, text)] * 50 + [(2, text[:400] + "".join(draw.choices("xyz", k=400)))], "doc_id long, text string").repartition(4)
    rows = suffixes.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in rows) == Counter({(1, 700): 50, (2, 400): 1})
    assert bytes(next(r["kept"] for r in rows if r["doc_id"] == 2)).decode().strip("xyz") == ""


def test_no_task_depends_on_where_pieces_end():
    draw = np.random.default_rng(3)
    data = draw.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 1200, 1200, 1350, 5000])
    whole = suffixes._places(data, offsets, 200, (5, 7))
    assert (np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[1], whole[2])]) == np.concatenate([np.arange(1001), np.arange(1350, 4801)])).all()
    assert all(low <= at <= high + 136 for at, low, high in zip(*whole[:3]))


def test_texts_that_were_written_to_have_equal_names(spark):
    draw = random.Random(8)
    tail = "".join(draw.choices("abcdefgh ", k=400))
    texts = ["T4U}^+cwozvthar" + "x", "'`wKgdMl%tjmogsok", "other sixteen by"]
    docs = spark.createDataFrame([(i, t + tail) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert [r["n_removed"] for r in suffixes.remove_repeats(docs).orderBy("doc_id").collect()] == [400] * 3


def test_blocks_of_a_shuffled_input_with_repeated_rows(spark):
    draw = random.Random(10)
    rows = [(k % 5, "".join(draw.choices("abcdef", k=300))) for k in range(40)] * 3 + [(None, "q" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    found = suffixes.remove_repeats(docs).drop("kept")
    assert Counter(tuple(r) for r in found.collect()) == Counter((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 200)))
