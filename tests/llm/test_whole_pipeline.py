"""The whole pipeline, stage by stage, against plain versions of what each stage keeps."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from homelens.llm import storage, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    draw = random.Random(21)
    letters = {"xx": "abcdefg", "yy": "mnopqrs"}
    vocabulary = {lang: ["".join(draw.choices(some, k=draw.randrange(3, 8))) for _ in range(400)] for lang, some in letters.items()}
    line = lambda lang, n: " ".join(draw.choices(vocabulary[lang], k=n))
    texts = []
    for k in range(48):
        lang = ("xx", "yy")[k % 2]
        texts.append((lang, [line(lang, draw.randrange(12, 30)) for _ in range(draw.randrange(3, 7))]))
    shared, short = line("xx", 14), line("xx", 3)
    for k in (2, 9, 20):
        texts[k][1].insert(1, shared)
        texts[k][1].append(short)
    texts[30][1].insert(0, " ".join(shared.split(" ")[:-1] + ["other"]))  # one word replaced
    texts[31][1].insert(0, shared + " more")  # one word put in
    texts[32][1].append("")  # a blank line stays
    near = " ".join(texts[0][1]).split(" ")
    near[len(near) // 2] = "changed"
    rows = [(k, "\n".join(lines), lang, f"s{k % 4}" if k % 11 else None) for k, (lang, lines) in enumerate(texts)]
    rows += [(100, " ".join(near), "xx", "s1"), (101, texts[5][1][0] + "\n" + texts[7][1][1], "yy", "s2"), (102, "12 34 !!", "xx", "s0"), (103, None, "xx", "s0"), (104, "", "yy", "s1")]
    rows += [(105, " ".join(texts[4][1]), "xx", "s3"), (106, " ".join(texts[4][1]).upper(), "xx", "s2"), (None, line("yy", 60), "yy", "s1"), (60, texts[8][1][0] + "\n" + line("xx", 90), "xx", "s0")]
    return [(*r, len(r[1] or "")) for r in rows]


def close(a, b):
    """Whether two lists of words, one of them of eight words or more, are one word apart at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def without_repeated_lines(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    seen, out = [], []
    for doc_id, text, lang, source, n in order:
        kept, lost = [], 0
        for part in (text or "").split("\n"):
            words = WORD.findall(part)
            gone = bool(words) and any(close(words, other) for other in seen)
            if words:
                seen.append(words)
            lost += gone
            kept += [] if gone else [part]
        left = "\n".join(kept)
        if not lost or WORD.search(left):
            out.append((doc_id, left if lost else text, lang, source, len(left) if lost else n))
    return out


def shingles(text):
    words = [w.lower() for w in WORD.findall(text or "")]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def first_of_each_group(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    sets = [shingles(r[1]) for r in order]
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(order)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for k, r in enumerate(order) if find(k) == k]


def targets(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    out, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        free = [s for s in names if s not in capped]
        out = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 3 * size[s]}
        if not over:
            return out, size
        capped |= over


def pieces(rows):
    fresh = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for r in rows:
        ids = np.array([*fresh.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        marks = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        want.update((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(marks, marks[1:])))
    return want


def test_every_stage_of_the_whole_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.materialize(stage(spark, docs, str(tmp_path)), "whole-pipeline")
        kept[name] = [tuple(r) for r in docs.collect()]
    assert Counter(kept["language_id"]) == Counter(r for r in rows if re.search("[a-z]", r[1] or "", re.I))
    assert Counter(kept["line_dedup"]) == Counter(without_repeated_lines(kept["language_id"]))
    assert len(kept["line_dedup"]) == len(kept["language_id"]) - 1  # one document had only repeated lines
    assert Counter(kept["ngram_jaccard_join"]) == Counter(first_of_each_group(kept["line_dedup"]))
    assert not {100, 105, 106} & {r[0] for r in kept["ngram_jaccard_join"]}
    goal, size = targets(kept["ngram_jaccard_join"])
    taken, most = Counter(), max(len(WORD.findall(r[1])) for r in kept["ngram_jaccard_join"])
    for r in kept["mixing"]:
        taken[r[3]] += len(WORD.findall(r[1]))
    assert all(abs(taken[s] - goal[s]) <= most and taken[s] <= 3 * size[s] for s in goal)
    copies, known = Counter(kept["mixing"]), set(kept["ngram_jaccard_join"])
    assert set(copies) <= known and max(copies.values()) <= 3
    assert Counter(r[:5] for r in kept["best_fit_packing"]) == pieces(kept["mixing"])
    by = {}
    for r in kept["best_fit_packing"]:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in again) == Counter(r[:5] for r in kept["best_fit_packing"])
