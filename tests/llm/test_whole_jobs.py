"""Hard rows that earlier forms of the operators left out."""

from collections import Counter

import corpus_pipeline
from homelens.llm import lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SAME = "one two three four five six seven eight nine"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)


def test_lines_of_documents_without_an_id_or_with_one_id(spark):
    repeated = [(1, f"{SAME}\nalpha")]
    for ids in ((None, None, None), (7, 7, 7)):
        docs = rows_of(spark, [*repeated, (ids[0], f"beta\n{SAME}"), (ids[1], "gamma\ndelta clean line"), (ids[2], f"epsilon\n{SAME.replace('two', 'TWO')}"), (ids[2], None)])
        got = Counter((r["doc_id"], r["_kept"]) for r in lines.dedup_lines(docs).collect())
        assert got == Counter([(1, f"{SAME}\nalpha"), (ids[0], "beta"), (ids[1], "gamma\ndelta clean line"), (ids[2], "epsilon"), (ids[2], None)])
        both = rows_of(spark, [(ids[0], "shared line here\nbeta"), (ids[1], "shared line here\ngamma"), (ids[0], "shared line here\nbeta")])
        kept = Counter(r["_kept"] for r in lines.dedup_lines(both).collect())
        assert kept in (Counter({"shared line here\nbeta": 2, "gamma": 1}), Counter({"beta": 2, "shared line here\ngamma": 1}))


def test_near_copies_without_an_id_or_with_one_id(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(100))
    near = lambda k: text(k).replace(f"w{k}x99", "other")
    pairs = [(None, text(0)), (None, near(0)), (None, text(0)), (None, text(1)), (4, near(1)), (5, text(2)), (5, text(3)), (5, text(3)), (6, near(3)), (None, " "), (None, " "), (8, " ")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, rows_of(spark, pairs), "").collect()]
    first = [x for x in got if x[1] in (text(0), near(0))]
    assert len(first) == 1 and first[0][0] is None
    assert Counter(x for x in got if x not in first) == Counter([(4, near(1)), (5, text(2)), (5, text(3)), (None, " "), (None, " "), (8, " ")])


def test_one_very_long_document_does_not_end_the_fill(spark):
    from homelens.llm import mixing

    rows = [(k, "a", 40) for k in range(4000)] + [(1000 * j + k, f"b{j}", 12000 if k == 7 else 40) for j in range(10, 22) for k in range(300)]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for s in {r[1] for r in rows}:
        some = [r for r in got if r["source"] == s]
        floor = min(3, int(some[0]["target"] / some[0]["source_size"] + 1e-12))
        rest = some[0]["target"] - floor * some[0]["source_size"]
        extra = sum(r["taken"] for r in some) - floor * some[0]["source_size"]
        left = [r for r in some if r["copies"] == floor and r["size"] == 40]
        assert extra <= rest + 1e-6 and (rest - extra < 40 or not left), (s, rest, extra)


def test_added_tokens_are_the_librarys():
    from homelens.llm import tokens
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z\nmore <|endoftext|>\n", "plain words\nand lines", "<|endoftext|><|endoftext|> two  spaces", "word", None]
    ids, bounds = tokens.Encoder(tokens.default_tokenizer()).encode(texts)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*fresh.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]
    assert bounds[2] - bounds[1] == 2
