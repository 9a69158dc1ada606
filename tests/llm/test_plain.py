"""Language codes, packing, mixing and weak rules against plain versions of themselves."""

import random
import zlib
from collections import Counter
from math import exp, log, sqrt

import numpy as np
from homelens.llm import langid, mixing, packing, quality, tokens
from tokenizers import Tokenizer


def test_predictions_of_language_codes(spark):
    draw = random.Random(1)
    tongue = {"en": "the of and thing", "de": "der und über ist", "fr": "le été à où", "es": "el niño que años"}
    made = [(i, " ".join(draw.choices((w + " it a re").split(), k=draw.randrange(0, 25))), lang) for i, (lang, w) in enumerate(list(tongue.items()) * 30)]
    rows = [*made, (500, None, "en"), (501, "A", "de"), (502, "Zé!?é", None), made[3]]
    letters = lambda t: [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (t or "").encode()]
    grams = lambda t: [((x * 63689 + y * 378551 + z * 2654435761) % 2**32 >> 7) % langid.BUCKETS for c in [letters(t)] for x, y, z in zip(c, c[1:], c[2:])]
    counts = {lang: Counter() for lang in sorted(tongue)}
    for i, text, lang in rows:
        if text is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(grams(text))
    langs = sorted(lang for lang, c in counts.items() if c)
    share = {lang: {b: (counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * langid.BUCKETS) for b in range(langid.BUCKETS)} for lang in langs}
    code = langid.codewords(len(langs))
    bits = range(code.shape[1])
    mean = lambda bit, sign, b: np.mean([share[lang][b] for k, lang in enumerate(langs) if code[k][bit] * sign > 0])
    used = sorted(set().union(*counts.values(), *(grams(r[1]) for r in rows)))
    weight = {b: [log(mean(bit, 1, b)) - log(mean(bit, -1, b)) for bit in bits] for b in used}
    model = langid.Model(langs, np.array([[counts[lang][b] for b in range(langid.BUCKETS)] for lang in langs], float))
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in rows:
        r, g = got[(i, text)], grams(text)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = [sum(weight[b][bit] for b in g) for bit in bits]
        n = max(len(g), 1)
        losses = [sum(float(model.trust[bit]) * log(1 + exp(-sums[bit] / n * min(n, 60) * code[k][bit])) for bit in bits) for k in range(len(langs))]
        odds = [exp(min(losses) - x) for x in losses]
        assert r["lang_pred"] == langs[int(np.argmax(odds))] and abs(r["score"] - max(odds) / sum(odds)) < 1e-4


def test_pieces_and_places_of_documents(spark):
    fresh = Tokenizer.from_file(tokens.default_tokenizer())
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["alpha", "beta", "gamma42", "\n", "é"], k=draw.choice([0, 1, 5, 40, 90, 200]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, texts[4]), (77, None), (78, "")]
    limit, want = 64, Counter()
    for i, text in rows:
        ids = np.array([*fresh.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % limit or limit
        marks = [0, *range(min(first, len(ids)), len(ids) + 1, limit)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(marks, marks[1:])))
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= limit


def plain_two_fit(lengths, limit):
    """One bin at a time, document by document."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        filled, gap = [], limit
        for x in list(left):
            if x <= gap:
                filled.append(x)
                left.remove(x)
                gap -= x
        if gap and len(filled) > 1:
            small = min(filled)
            pairs = [(a + b, a, b) for k, a in enumerate(left) for b in left[k + 1 :] if small < a + b <= gap + small]
            if pairs:
                _, a, b = max(pairs)
                filled.remove(small)
                left = sorted([*left, small], reverse=True)
                for x in (a, b):
                    left.remove(x)
                filled += [a, b]
        bins.append(sorted(filled))
    return bins


def test_plan_fills_like_a_plain_best_two_fit():
    draw = np.random.default_rng(4)
    for limit, n in ((20, 60), (64, 150), (100, 40)):
        lengths = draw.integers(1, limit + 1, n).tolist() + draw.integers(1, limit // 4 + 1, n).tolist()
        plan = packing.best_two_fit(np.bincount(lengths, minlength=limit + 1))
        bins = [sorted(x for x, k in filled.items() for _ in range(k)) for filled, times in plan for _ in range(times)]
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= limit for b in bins)
        assert abs(len(bins) - len(plain_two_fit(lengths, limit))) <= 1


def test_takings_of_documents(spark):
    draw = random.Random(5)
    rows = [(i if i % 50 else None, " ".join(["w"] * draw.choice([0, 1, 3, 8, 30, 31])), draw.choice(["a", "b", "b", "b", "c", None])) for i in range(1500)]
    rows += [(9000, "one two\tthree\x0bfour\n five", "b"), (9001, None, "c"), (9000, "one two\tthree\x0bfour\n five", "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = lambda t: len((t or "").replace("\x0b", " ").split())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    targets = {r["source"]: r["target"] for r in got}
    taken = Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        low = min(3, int(r["target"] / r["source_size"] + 1e-12))
        assert r["copies"] in (low, min(3, low + 1)) and len(r["homes"]) == r["copies"]
        taken[r["source"]] += r["taken"]
    for s, target in targets.items():
        assert target - 31 <= taken[s] <= target + 1e-6
    draws = Counter(home for r in got for home in r["homes"])
    assert set(draws) <= set(range(mixing.SHARDS))


def test_blocks_are_taken_as_often_as_shards_draw_them(spark):
    rows = [(i, "w " * 5, s) for s, n, at in (("a", 2000, 0), ("b", 900, 3000), ("c", 150, 5000)) for i in range(at, at + n)] + [(9000 + i, None, "d") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sized_documents(docs)
    plan = mixing.mix_plan(sized, 8).collect()
    decks = {}
    for r in plan:
        decks.setdefault(r["skey"], {})[r["block"]] = r
    quotas = {k: sum(len(r["homes"]) for r in blocks.values()) for k, blocks in decks.items()}
    assert quotas["sd"] <= len(decks["sd"])
    tree = {r["skey"]: r["by_shard"] for r in mixing.split_quotas(spark.createDataFrame(sorted(quotas.items()), "skey string, draws long"), 8).collect()}
    for k, blocks in decks.items():
        homes = Counter(h for r in blocks.values() for h in r["homes"])
        assert [homes[j] for j in range(8)] == tree[k]
        counts = {len(r["homes"]) for r in blocks.values()}
        assert max(counts) - min(counts) <= 1 and max(counts) <= 3
    for r in mixing.mix(docs, 8).collect():
        if r["source"] == "d":
            assert r["taken"] == 0 and r["size"] == 0 and r["target"] == 0


def test_posteriors_of_plain_expectation_maximisation(spark):
    draw = random.Random(6)
    k = len(quality.rules())
    patterns = Counter(tuple(draw.choices([1, 0, -1], [8, 2, 1], k=k)) for _ in range(300)) + Counter(tuple(draw.choices([1, 0, -1], [2, 3, 4], k=k)) for _ in range(60))
    share, w = 0.8, [(log(0.97 / 0.5), log(0.03 / 0.5))] * k
    chance = lambda v: 1 / (1 + exp(-(log(share / (1 - share)) + sum(g if x == 1 else b if x == -1 else 0 for x, (g, b) in zip(v, w)))))
    n = sum(patterns.values())
    for _ in range(quality.ROUNDS):
        q = {v: chance(v) for v in patterns}
        prior, rates = 5 + 0.002 * n, []
        for j in range(k):
            on = lambda f, good: sum(c * (q[v] if good else 1 - q[v]) * f(v[j]) for v, c in patterns.items())  # noqa: B023, E731
            good = min(0.1, (on(lambda x: x == -1, True) + 0.03 * prior) / (on(abs, True) + prior))
            bad = max(0.2, (on(lambda x: x == -1, False) + 0.5 * prior) / (on(abs, False) + prior))
            rates.append((log((1 - good) / (1 - bad)), log(good / bad)))
        share, w = min(0.95, max(0.05, sum(q[v] * c for v, c in patterns.items()) / n)), rates
    rows = [(list(v),) for v, c in patterns.items() for _ in range(c)]
    got = {tuple(r["v"]): r["posterior"] for r in quality.posteriors(spark.createDataFrame(rows, "v array<int>")).collect()}
    assert set(got) == set(patterns) and all(abs(got[v] - chance(v)) < 1e-9 for v in patterns)
    assert sqrt(np.var(list(got.values()))) > 0.1
