"""Input columns with the operators' own names come back as they were; long lines and texts end."""

import random
import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from homelens.llm import langid, lines, mixing, tokenfiles
from pyspark.sql import functions as F

CLASHING = ["_did", "_tid", "_gone", "_kept", "_key", "_copy", "_shard", "_lettered", "_lang", "_sure", "_unclear", "_idless", "_own", "_each", "_nth", "_others", "cls", "at", "rank", "Key"]


@pytest.fixture(scope="module")
def clashing(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(200)]
    texts = [" ".join(draw.choices(vocabulary, k=90)) for _ in range(40)]
    texts += [texts[0] + "\n" + texts[1], None, "", texts[2]]
    rows = [(i if i != 7 else None, t, "en", f"s{i % 3}", len(t or ""), *([i * 100] * len(CLASHING))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHING))


def values(df, names):
    return Counter(tuple(r) for r in df.select(*[F.col(f"`{n}`") for n in names]).collect())


def test_operators_leave_other_columns_alone(spark, clashing):
    others = [c for c in clashing.columns if c != "text"]
    found = lines.dedup_lines(clashing, ("gone_now", "kept_now"))
    assert found.columns == [*clashing.columns, "gone_now", "kept_now"]
    assert values(found, clashing.columns) == values(clashing, clashing.columns)
    assert langid.identify(clashing).columns == [*clashing.columns, "lang_pred", "score", "ambiguous"]
    assert values(langid.identify(clashing), clashing.columns) == values(clashing, clashing.columns)
    mixed = mixing.mixed_documents(clashing, 1000, 4)
    assert mixed.columns == clashing.columns and set(values(mixed, others)) <= set(values(clashing, others)) and mixed.count() > 20


@pytest.mark.parametrize("k", range(4))
def test_stages_leave_other_columns_alone(spark, clashing, k):
    others = [c for c in clashing.columns if c not in ("text", "n_chars")]
    found = corpus_pipeline.STAGES[k][1](spark, clashing, "")
    assert found.columns == clashing.columns
    assert set(values(found, others)) <= set(values(clashing, others)) and found.count() > 20


def test_a_very_long_line(spark):
    draw = random.Random(2)
    words = [f"w{draw.randrange(10**6)}" for _ in range(200_000)]
    other = [*words[:150_000], "another", *words[150_001:]]
    less = [*words[:70_000], *words[70_001:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(less)), (4, " ".join(words[:100_000]))], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r["_gone"] for r in lines.dedup_lines(docs).collect()}
    assert got == {1: None, 2: [0], 3: [0], 4: None} and time.time() - start < 120


def test_running_values(spark):
    for n in (1, 2, 3, 8, 9, 17, 100):
        row = spark.range(1).select(F.array(*[F.lit(k * k + 3).cast("long") for k in range(n)]).alias("h")).select(lines._running("h").alias("r")).first()
        assert row["r"] == np.append(0, np.bitwise_xor.accumulate([k * k + 3 for k in range(n)])).tolist()


def test_prediction_of_a_long_text_goes_step_by_step(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the of and thing " * 20, "en"), (3, "der und ist über " * 20, "de"), (4, "the of and " * 200, None), (6, "x", None)], "doc_id long, text string, lang string")
    whole = [tuple(r) for r in langid.identify(docs).orderBy("doc_id").collect()]
    monkeypatch.setattr(langid, "STEP", 7)
    small = [tuple(r) for r in langid.identify(docs).orderBy("doc_id").collect()]
    assert [r[:4] for r in whole] == [r[:4] for r in small] and np.allclose([r[4] for r in whole], [r[4] for r in small])


def test_select_of_many():
    draw = np.random.default_rng(1)
    for values_ in (np.cumsum(draw.integers(0, 900, 3000)), np.repeat(np.arange(5), 400), np.array([0, 0, 10**9])):
        coded = tokenfiles.EliasFano.encode(values_, int(values_[-1]) + 1)
        for a in range(0, len(values_), 97):
            b = min(len(values_), a + int(draw.integers(1, 700)))
            assert coded.between(a, b).tolist() == values_[a:b].tolist()


def test_files_are_closed_when_full(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "HELD", 50)
    docs = spark.createDataFrame([(i // 3 if i % 5 else None, f"text number {i % 11} " * (i % 4)) for i in range(90)], "doc_id long, text string")
    got = [tuple(r) for r in tokenfiles.token_files(docs).orderBy("start").collect()]
    assert Counter(r[0] for r in got) == Counter(r[0] for r in docs.collect())
    assert [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got]))[:-1].tolist()
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda d: (d is not None, d or 0))
    assert got == [tuple(r) for r in tokenfiles.token_files(docs.repartition(3)).orderBy("start").collect()]


def test_long_words_have_names_of_their_own():
    """The Thue-Morse word and its complement, which collide under any polynomial modulo 2^64."""
    import numpy as np

    from homelens.llm import bytesets

    bits = [bin(k).count("1") % 2 for k in range(4096)]
    for n in (512, 1024, 2048, 4096):
        raw = "".join("ab"[b] for b in bits[:n]) + " " + "".join("ba"[b] for b in bits[:n])
        names, _ = bytesets.word_hashes(np.frombuffer(raw.encode(), np.uint8), np.array([0, len(raw)]))
        assert len(set(names.tolist())) == 2
    upper = ("A" * 300 + " " + "a" * 300).encode()
    names, _ = bytesets.word_hashes(np.frombuffer(upper, np.uint8), np.array([0, len(upper)]))
    assert names[0] == names[1]
