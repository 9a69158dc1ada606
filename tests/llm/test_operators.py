"""Operators against brute force on small documents with hard rows: nulls, empties, ties, repeats, long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from homelens.llm import bytesets, langid, lines, lm, mixing, neardup, packing, quality, registry, setjoin, suffixes, tokenfiles, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, block string, shard int, key string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdefghé", k=draw.randrange(2, 8))) for _ in range(300)]
    texts = []
    for i in range(60):
        body = draw.choices(vocabulary, k=draw.randrange(30, 200))
        texts.append(" ".join(body[:50]) + "\n" + " ".join(body[50:]))
    near = texts[0].split(" ")
    for place in (3, 20, 40):
        changed = list(near)
        changed[place] = "Changed"
        texts.append(" ".join(changed))
    texts += [texts[1], texts[1], texts[2].upper(), "x", "", " \n\t ", None, "a b", "A  b", "###$$$ %%% 12", texts[5] + " " + texts[6] + " " + texts[5], " ".join(draw.choices(vocabulary, k=9000))]
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 9 == 0 else f"s{i % 4}", "b", 1, "k") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, texts[3], None, "s1", "b", 1, "k")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_equals_the_library():
    encoder = tokens.encoder(tokens.default_tokenizer())
    texts = ["a  b", "a   b", " a b ", "a\n b", "a\n \nb", "x \n y", "", None, "\n\n a", "tab\t b", "it's 's 'S don't", "a<|endoftext|> b", "  ", "é  ñ\r\n z", "日本 語 ", "plain words\nin lines", "end\n"]
    ids, bounds = encoder.encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_elias_fano_round_trip():
    draw = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0, 5, 5, 10**9], np.cumsum(draw.integers(0, 900, 5000)), np.arange(3000)):
        values = np.array(values, np.int64)
        coded = tokenfiles.EliasFano.encode(values, int(values[-1]) + 1 if len(values) else 1)
        assert coded.decode().tolist() == values.tolist()
        assert all(coded.select(i) == values[i] for i in range(0, len(values), 37))


def test_token_files(docs, rows, none):
    encoder = tokens.encoder(tokens.default_tokenizer())
    at, want = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids, _ = encoder.encode([text])
        want.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in tokenfiles.token_files(docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenfiles.token_files(none).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, limit=256).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by) <= 1.02 * -(-sum(r["length"] for r in got) // 256) + 1
    assert packing.pack_documents(none).count() == 0


def test_two_documents_take_the_place_of_the_smallest():
    histogram = np.zeros(11, int)
    histogram[[6, 3, 2]] = 1, 1, 2
    plan = packing.best_two_fit(histogram)
    assert plan[0] == ({6: 1, 2: 2}, 1)


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_jaccard_components(docs, rows, percent, width):
    sets = {}
    for i, r in enumerate(rows):
        words = WORD.findall(lower(r[1] or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in setjoin.jaccard_components(docs, percent, width).collect()) == want


def test_segments_find_every_pair_within_the_bound():
    draw = np.random.default_rng(2)
    for percent in (80, 90):
        scheme = setjoin.Scheme(percent)
        for size in (5, 12, 30, 150, 600):
            for _ in range(20):
                base = draw.integers(1, 2**63, size, dtype=np.uint64)
                changes = int(size * (100 - percent) // (100 + percent))
                other = np.sort(np.concatenate([base[changes:], draw.integers(1, 2**63, changes, dtype=np.uint64)]))
                both = len(np.intersect1d(base, other))
                if 100 * both < percent * (2 * size - both) or changes == 0:
                    continue
                keys, row, *_ = scheme.keys(np.concatenate([np.sort(base), other]), np.array([0, size, 2 * size]))
                assert len(np.intersect1d(keys[row == 0], keys[row == 1]))


def test_shared_passages_lose_no_link(spark):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    passages = [draw.choices(vocabulary, k=60) for _ in range(3)]
    texts = []
    for i in range(40):
        own = draw.choices(vocabulary, k=draw.choice([4, 15, 40, 90]))
        words = own[: len(own) // 2] + passages[i % 3] + own[len(own) // 2 :]
        for _ in range(draw.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 2, 3, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(copy)
    for i in range(60):
        base = draw.choices(vocabulary, k=draw.randrange(5, 14))
        texts += [base, base[1:], [*base, "end"]]
    for percent, width in ((80, 5), (90, 3), (60, 2)):
        sets = [{tuple(t[k : k + width]) for k in range(max(1, len(t) - width + 1))} for t in texts]
        label = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
        made = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        assert {r[0]: r[2] for r in setjoin.jaccard_components(made, percent, width).collect()} == dict(enumerate(label))


def test_empty_table_of_the_joins(none):
    assert setjoin.jaccard_components(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert lines.dedup_lines(none).count() == 0


def test_repeated_strings(docs, rows):
    window = 80
    seen = Counter()
    texts = [(r[1] or "").encode() for r in rows]
    for t in texts:
        seen.update(t[i : i + window] for i in range(len(t) - window + 1))
    want = Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[(r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in suffixes.remove_repeats(docs, window).drop("kept").collect()) == want


def test_line_dedup_equals_its_sql(spark, docs, rows):
    one = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    extra = [(100 + i, t, None, None, "b", 1, "k") for i, t in enumerate(["one two three four five six seven eight nine\n\nshort line", "one two three four FIVE six seven eight nine\nshort line", "one two three four five six seven eight nine ten", "zero one two three four five six seven eight nine", "two one three four five six seven eight nine", "short lime"])]
    small = one.unionByName(spark.createDataFrame(extra, SCHEMA))
    documents = small.select("doc_id", "text").toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(lines.ORACLE).fetchall()
    found = lines.dedup_lines(small)
    got = {r["doc_id"]: (len(r["_gone"] or []), r["_kept"] or "") for r in found.collect()}
    assert {d: (n, hashlib.md5(t.encode()).hexdigest()) for d, (n, t) in got.items()} == {w[0]: (w[2], w[4]) for w in want}
    assert sum(n for n, _ in got.values()) > 5


def test_quality_measures(docs, rows, none):
    want = Counter()
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        places = {}
        for i in range(len(words) - 2):
            places.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
        filled = [x for x in text.split("\n") if WORD.search(x)]
        want[(r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(filled) - len(set(filled)), len(covered))] += 1
    judged = quality.judge(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in judged) == want
    assert all(not r["kept"] for r in judged if r["n_words"] < 50)
    assert quality.judge(none).count() == 0


def test_weak_rules_part_junk_from_prose(spark):
    good = [([1, 1, 1, 1, 1, 1, 1],)] * 900 + [([1, 1, 1, 1, 1, 0, 1],)] * 50
    junk = [([1, 1, -1, -1, 1, 0, 1],)] * 60 + [([1, 1, 1, 1, -1, 1, 1],)] * 5
    got = {tuple(r["v"]): r["posterior"] for r in quality.posteriors(spark.createDataFrame(good + junk, "v array<int>")).collect()}
    assert got[(1, 1, 1, 1, 1, 1, 1)] > 0.9 and got[(1, 1, -1, -1, 1, 0, 1)] < 0.5 and got[(1, 1, 1, 1, -1, 1, 1)] > 0.5


def test_mix(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    targets, taken, sizes = {}, Counter(), Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and len(r["homes"]) == r["copies"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
    assert sum(sizes.values()) == sum(len(WORD.findall(r[1] or "")) for r in rows)
    names = sorted((x for x in sizes if x is not None)) + [None]
    weights = {x: i % 3 + 1 for i, x in enumerate(names)}
    want, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[x] for x in capped)
        share = sum(weights[x] for x in names if x not in capped)
        want = {x: 3.0 * sizes[x] if x in capped else rest * weights[x] / share for x in names}
        over = {x for x in names if x not in capped and want[x] > 3 * sizes[x]}
        if not over:
            break
        capped |= over
    assert all(abs(want[x] - targets[x]) < 1e-6 * max(1, want[x]) for x in names)
    assert all(abs(taken[x] - targets[x]) <= 0.1 * targets[x] + 60 for x in names if sizes[x] < 9000)
    assert Counter(map(str, got)) == Counter(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0


def test_tree_splits_exactly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0), ("d", 1)], "skey string, draws long")
    got = {r["skey"]: r["by_shard"] for r in mixing.split_quotas(quotas, 8).collect()}
    assert {k: sum(v) for k, v in got.items()} == {"a": 1000, "b": 37, "c": 0, "d": 1}
    loads = [sum(v[i] for v in got.values()) for i in range(8)]
    assert max(loads) - min(loads) <= 1
    assert all(90 < x < 160 for x in got["a"])


def test_language_codes(spark, none):
    draw = random.Random(1)
    tongue = {"en": "the of and thing", "de": "der und über ist", "fr": "le été à où", "es": "el niño que años"}
    made = [(i, " ".join(draw.choices(w.split() + [l * 2], k=30)), l) for i, (l, w) in enumerate(list(tongue.items()) * 40)]
    rows = [*made, (1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "a", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    right = [got[i]["lang_pred"] == l for i, _, l in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["ambiguous"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none).count() == 0
    for k in (2, 4, 6, 9):
        assert len(np.unique(langid.codewords(k), axis=0)) == k


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney(docs, rows, none, order):
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    cut = lambda t: WORD.findall(lower(t or "")) + ["\n"]
    ending = lambda w, i, k: tuple(["\0", *w[: i + 1]] if i == k - 2 else w[i + 1 - k : i + 1])
    counts = Counter(w for r in train for w in cut(r[1]))
    n, v = sum(counts.values()), len(counts)
    raw = {k: Counter(ending(w, i, k) for w in (cut(r[1]) for r in train) for i in range(k - 2, len(w))) for k in range(2, order + 1)}
    used, sums = {order: raw[order]}, {}
    for k in range(order - 1, 0, -1):
        before = Counter(g[1:] for g in raw[k + 1])
        used[k] = before if k == 1 else {g: before.get(g, c) for g, c in raw[k].items()}
    discount = {k: lm._discounts([sum(x == j for x in used[k].values()) for j in (1, 2, 3, 4)]) for k in used}
    for k in range(2, order + 1):
        for g, c in used[k].items():
            sums.setdefault(g[:-1], [0, 0, 0, 0])[0] += c
            sums[g[:-1]][min(c, 3)] += 1
    types = len(raw[2])
    spare = sum(discount[1][min(c, 3)] for c in used[1].values()) / types / (v + 1)

    def chance(g):
        c = used[len(g)].get(g, 0)
        held = c - discount[len(g)][min(c, 3)]
        if len(g) == 1:
            return max(held, 0) / types + spare
        if g[:-1] not in sums:
            return chance(g[1:])
        total, *seen = sums[g[:-1]]
        return max(held, 0) / total + sum(discount[len(g)][j] * seen[j - 1] for j in (1, 2, 3)) / total * chance(g[1:])

    model = lm.train(docs.filter(~langid.held_out(F.col("doc_id"), 5, 1)), order)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs, model).collect()), key=str)
    want = []
    for r in rows:
        w = cut(r[1])
        score = float(sum(np.log10(chance(ending(w, i, min(order, i + 2)))) for i in range(len(w))))
        want.append((r[0], len(w), sum(counts[x] > 0 for x in w), n, round(float(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)), 6), round(score, 6)))
    for a, b in zip(got, sorted(want, key=str)):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], atol=2e-6)


def test_language_model_without_training_rows(docs, none):
    untrained = lm.score(docs, lm.train(none)).collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in untrained)


def test_near_vectors(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 16))
    near = base[draw.integers(0, 40, 300)] + draw.normal(size=(300, 16)) * 0.15
    rows = [(i, x.tolist()) for i, x in enumerate(near)] + [(300 + i, near[0].tolist()) for i in range(20)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None, 1.0]), (404, (near[1] * 7).tolist()), (405, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.linked_vectors(df).collect()}
    ids = [r[0] for r in rows if r[0] < 400 or r[0] == 404]
    x = np.array([r[1] for r in rows if r[0] in set(ids)])
    links = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    np.fill_diagonal(links, False)
    label = np.arange(len(ids))
    for _ in ids:
        label = np.minimum(label, np.where(links, label[None], len(ids)).min(1))
    want = {d: (int(links[i].sum()), ids[label[i]], label[i] == i) for i, d in enumerate(ids)} | {d: (0, d, True) for d in (400, 401, 402, 403, 405)}
    want[403] = (got[403][0], got[403][1], got[403][2])
    assert got == want and got[403][0] == 0
    assert neardup.linked_vectors(df.filter("false")).count() == 0


def test_shingles_of_short_and_empty_texts():
    import pyarrow as pa

    data, offsets = bytesets.text_buffers(pa.array(["a b", "A B", "", None, "a b c", "c b a"]))
    words, at = bytesets.word_hashes(data, offsets)
    sets, bounds = bytesets.shingles(words, at, 3)
    assert np.diff(bounds).tolist() == [1, 1, 0, 0, 1, 1]
    assert sets[0] == sets[1] and sets[2] != sets[3]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_large_groups_of_near_copies(spark):
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size, changes in ((700, 1), (300, 3), (40, 6)):
        base = draw.choices(vocabulary, k=80)
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randrange(changes + 1)):
                copy[draw.randrange(80)] = draw.choice(vocabulary)
            texts.append(copy)
    chain = draw.choices(vocabulary, k=60)
    for _ in range(120):
        chain = chain[1:] + [draw.choice(vocabulary)]
        texts.append(chain)
    made = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for percent, width in ((90, 3), (80, 5)):
        sets = [{tuple(t[k : k + width]) for k in range(len(t) - width + 1)} for t in texts]
        names = {x: i for i, x in enumerate(set().union(*sets))}
        grid = np.zeros((len(sets), len(names)), np.float32)
        for i, s in enumerate(sets):
            grid[i, [names[x] for x in s]] = 1
        both, size = grid @ grid.T, grid.sum(1)
        linked = 100 * both >= percent * (size[:, None] + size[None] - both)
        label = np.arange(len(sets))
        while True:
            low = np.where(linked, label[None], len(sets)).min(1)
            if (low == label).all():
                break
            label = low
        got = {r[0]: r[2] for r in setjoin.jaccard_components(made, percent, width).collect()}
        assert got == dict(enumerate(label.tolist())) and len(set(label.tolist())) < len(label) - 200
