"""Fill-in-middle forms against a plain version: nulls, repeats, marks, hot and very long texts."""

import hashlib
import random
import re
from collections import Counter

import pytest

from homelens.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def hard_rows():
    draw = random.Random(12)
    words = ["one", "two", "é", "日本語", "<P", "S>", "<", " ", "x y", "😀"]
    gaps = [" ", "  ", "\n", "\t ", "\r\n", "\x0b", "\x0c"]
    texts = ["", None, " ", "\n\n ", "a", " a", "a ", "a <P> b", "b <S>", "<M>", "<P<P", "<S<M>x"]
    texts += ["".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(1, 40))) for _ in range(60)]
    rows = list(enumerate(texts))
    rows += [(None, texts[20]), (None, None), (7, texts[21]), (7, texts[21]), (8, texts[22])]
    rows += [(1000 + k, "the same text for many") for k in range(300)] + [(5000, "the same text for many")] * 40
    return rows + [(9000 + k, "long words " * 200_000 + str(k)) for k in range(2)]


@pytest.mark.parametrize("hot, held", [(2000, 32 << 20), (20, 200)])
def test_forms_of_hard_rows(spark, monkeypatch, hot, held):
    monkeypatch.setattr(infill, "HOT", hot)
    monkeypatch.setattr(infill, "HELD", held)
    rows = hard_rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, name int, share string, n int").repartition(5)
    found = infill.fill_in_middle(docs).withColumn("again", infill.restored(infill.F.col("output"), infill.F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(plain(*r) for r in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    assert all(r["again"] in texts[r["doc_id"]] for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_unit_ends_do_not_depend_on_steps(monkeypatch):
    draw = random.Random(13)
    for step in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(infill, "STEP", step)
        for _ in range(60):
            text = "".join(draw.choices("ab é日\n\t 😀", k=draw.randrange(0, 30)))
            ends = infill.unit_ends(text).tolist()
            assert ends == [m.end() for m in UNIT.finditer(text)]
            assert infill.boundaries(text).decode().tolist() == ends


def test_no_rows(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
