"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the
counts of vote patterns (at most 3 to the number of rules, however many documents) estimates how often
each rule's votes are right and how common good documents are; a document is kept by its posterior
probability of being good, not by passing every rule.

Defined results: null and empty text has no words and fails the base rule; repeated rows are judged
each; an empty table gives no rows; other columns are ignored. Windows of three words are compared by
64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.llm import storage

_BLANK = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_UNPROSE = _SYMBOLS + "0123456789@^_=+~{}[]/\\`"
ROUNDS = 30


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_unprose, n_lines, n_dup_lines, n_repeat_words, n_distinct_grams) of whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.trim(text, F.lit(_BLANK)).alias("body"))
    split = base.select(
        "doc_id",
        F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", r"[\x20\x09-\x0D]+")).alias("w"),
        F.length(F.translate("text", _BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", _UNPROSE, ""))).cast("long").alias("n_unprose"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_BLANK)) != "").alias("lines"),
    )
    grams = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_unprose",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("IF(size(w) < 3, CAST(array() AS array<bigint>), slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, size(w) - 2))").alias("g"),
    )
    counted = grams.withColumn("n_distinct_grams", F.size(F.array_distinct("g")).cast("long"))
    ordered = counted.withColumn("s", F.expr("IF(n_distinct_grams = size(g), CAST(array() AS array<struct<h:bigint,i:int>>), sort_array(transform(g, (h, i) -> named_struct('h', h, 'i', i))))"))
    twice = ordered.withColumn("at", F.expr("transform(filter(transform(s, (x, k) -> IF(x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h, x.i, -1)), i -> i >= 0), i -> array(i, i + 1, i + 2))"))
    return twice.select("doc_id", "n_words", "word_chars", "n_symbols", "n_unprose", "n_lines", "n_dup_lines", F.size(F.array_distinct(F.flatten("at"))).cast("long").alias("n_repeat_words"), "n_distinct_grams")


def rules() -> list[tuple[str, Column, Column]]:
    """(name, when it votes good, when it votes bad) on measured documents."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean, symbols = F.col("word_chars") / words, F.col("n_symbols") / words
    repeats, dups = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    fresh = F.col("n_distinct_grams") / F.greatest(F.col("n_words") - 2, F.lit(1))
    return [
        ("length", F.col("n_words") >= 80, F.col("n_words") < 50),
        ("word_length", mean.between(3, 10), (mean < 2) | (mean > 14)),
        ("symbols", symbols <= 0.02, symbols > 0.1),
        ("prose", F.col("n_unprose") <= 0.02 * F.col("word_chars"), F.col("n_unprose") > 0.1 * F.col("word_chars")),
        ("repeated_words", repeats <= 0.2, repeats > 0.4),
        ("repeated_lines", (dups <= 0.05) & (F.col("n_lines") > 1), dups > 0.3),
        ("fresh_windows", (fresh >= 0.8) & (F.col("n_words") >= 20), fresh < 0.5),
    ]


def _votes() -> Column:
    return F.array(*[F.when(good, 1).when(bad, -1).otherwise(0) for _, good, bad in rules()])


def posteriors(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(v, posterior) for each pattern of votes in ``votes`` (v array<int>), by expectation-maximisation.

    All patterns make one row; the rounds are one fold over it. Each rule has two error rates among its
    votes: bad votes on good documents (at most 0.1) and bad votes on bad documents (at least 0.2), so no
    rule is ever turned around; weak priors stand for votes not seen.
    """
    patterns = votes.groupBy("v").agg(F.count("*").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p"))
    k = len(rules())
    chance = "1D / (1D + exp(-(ln(m.share / (1D - m.share)) + aggregate(zip_with(x.v, m.w, (a, b) -> CASE a WHEN 1 THEN b.good WHEN -1 THEN b.bad ELSE 0D END), 0D, (s, t) -> s + t))))"
    total = lambda what: f"aggregate(e, 0D, (s, x) -> s + x.n * {what})"
    prior = f"(5D + 0.002D * {total('1D')})"
    on_good = f"least(0.1D, ({total('x.q * int(x.v[j] = -1)')} + 0.03D * {prior}) / ({total('x.q * abs(x.v[j])')} + {prior}))"
    on_bad = f"greatest(0.2D, ({total('(1D - x.q) * int(x.v[j] = -1)')} + 0.5D * {prior}) / ({total('(1D - x.q) * abs(x.v[j])')} + {prior}))"
    step = f"""transform(array(transform(p, x -> named_struct('v', x.v, 'n', x.n, 'q', {chance}))), e -> named_struct(
        'share', least(0.95D, greatest(0.05D, {total('x.q')} / {total('1D')})),
        'w', transform(sequence(0, {k - 1}), j -> transform(array(named_struct('g', {on_good}, 'b', {on_bad})),
            r -> named_struct('good', ln((1D - r.g) / (1D - r.b)), 'bad', ln(r.g / r.b)))[0])))[0]"""
    start = f"named_struct('share', 0.8D, 'w', transform(sequence(0, {k - 1}), j -> named_struct('good', ln(0.97D / 0.5D), 'bad', ln(0.03D / 0.5D))))"
    learned = one.withColumn("m", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> {step})"))
    return learned.select("m", F.explode("p").alias("x")).select("x.v", F.expr(chance).alias("posterior"))


def judge(docs: DataFrame) -> DataFrame:
    """Measured documents with votes, posterior, base_failed and kept."""
    measured = storage.materialize(measure(docs), "quality").withColumn("v", _votes())
    learned = F.broadcast(posteriors(measured.select("v")))  # at most 3 ** 7 rows
    joined = measured.join(learned, "v")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= 0.5))


def op9_weak_rules(spark, sf_dir: str) -> DataFrame:
    """Quality verdict on every document."""
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
