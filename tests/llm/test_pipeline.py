"""The pipeline's stages on a small corpus with hard rows."""

import random

from homelens.llm import storage

import corpus_pipeline


def test_stages(spark):
    draw = random.Random(9)
    words = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    texts = [" ".join(draw.choices(words, k=120)) for _ in range(30)]
    near = texts[0].split(" ")
    near[60] = "other"
    texts += [" ".join(near), texts[1], None, "", "12 34", "the same line of many words\n" + texts[2], "the same line of many words\n" + texts[3]]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        before, docs = docs, storage.materialize(stage(spark, docs, ""), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert ids == {i for i, t in enumerate(texts) if t and i != 34}
        if name == "line_dedup":
            assert not ids & {30, 31} and {0, 1} <= ids
        if name == "ngram_jaccard_join":
            assert {r[0] for r in before.select("doc_id").collect()} >= ids
    assert len(names) == 5 and docs.count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, empty, "").count() == 0
