"""Removal of repeated passages by reference factors against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from homelens.llm import blocks, factors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    for (doc_id, _), i, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        yield doc_id, len(w), sum(gone), tuple(spans), " ".join(x for x, g in zip(w, gone) if not g)


def hard_rows():
    draw = random.Random(9)
    some = lambda n, letters="abcdef": draw.choices(["".join(draw.choices(letters, k=draw.randrange(1, 4))) for _ in range(40)], k=n)
    passage, other = some(30), some(12)
    gap = lambda w: "".join(x + draw.choice([" ", " ", "  ", "\n", "\t"]) for x in w)
    texts = [None, "", " \n ", "a " * 12, "a " * 13, "a " * 30, "a b " * 20, "é ü " * 15, gap(passage), gap(passage[:13]), gap(passage[5:18]), gap(other)]
    texts += [gap(some(draw.randrange(0, 20)) + passage + some(draw.randrange(0, 20))) for _ in range(15)]
    texts += [gap(some(9) + other + some(9)) for _ in range(4)]
    base = some(120)
    for _ in range(10):
        copy = list(base)
        for _ in range(draw.randrange(0, 5)):
            copy[draw.randrange(len(copy))] = "#"
        texts.append(gap(copy))
    texts += [gap(base[:40] + base[80:]), gap(base[60:]), "word" * 500 + " " + gap(base), gap(some(300, "ab")), gap(some(300, "ab"))]
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [(None, gap(base)), (None, gap(passage)), (rows[8][0], gap(passage)), rows[8], rows[8], (-5, gap(passage[:20])), (rows[30][0], texts[31])]


@pytest.mark.parametrize("window, block, hot", [(13, 4 << 20, 64), (13, 300, 64), (13, 300, 0), (13, 60, 3), (8, 300, 2), (7, 500, 64)])
def test_passages_of_hard_rows(spark, monkeypatch, window, block, hot):
    rows = hard_rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, block int, shard string, ids int").repartition(3)
    monkeypatch.setattr(factors, "HOT", hot)
    monkeypatch.setattr(blocks, "_packed", lambda batches, most, whole=blocks._packed: whole(batches, block))
    found = factors.remove_passages(docs, window).collect()
    assert Counter((r[0], r[1], r[2], tuple((s["start"], s["length"]) for s in r[3]), r[4]) for r in found) == Counter(plain(rows, window))


def test_no_rows_and_a_very_long_text(spark, monkeypatch):
    assert factors.remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    draw = random.Random(2)
    words = ["w%d" % draw.randrange(10**6) for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[100_000:100_040]) + " y"), (3, " ".join(words[7:]))]
    found = {r["doc_id"]: r for r in factors.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k]["n_removed"] for k in (1, 2, 3)] == [0, 40, 299_993] and found[2]["kept"] == "x y" and found[3]["kept"] == ""


def test_word_numbers_do_not_depend_on_steps(monkeypatch):
    data = np.frombuffer(b"one two three fourfourfour five " * 50, np.uint8)
    first = np.array([m.start() for m in re.finditer(rb"\S+", data.tobytes())])
    end = np.array([m.end() for m in re.finditer(rb"\S+", data.tobytes())])
    whole = factors._hashes(data, first, end)
    monkeypatch.setattr(factors, "STEP", 9)
    assert (factors._hashes(data, first, end) == whole).all() and len(set(whole.tolist())) == 5
