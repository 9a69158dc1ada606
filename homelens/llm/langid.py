"""Language identification with error-correcting output codes over byte trigrams.

Every learned language gets a codeword. Each bit has its own binary classifier, a linear one on hashed
byte trigrams whose weights are the log ratio of the trigram distributions of the languages with the bit
set and those without. A text takes the language whose codeword has the least loss, each bit's logistic
loss weighted by how far its classifier parts the languages it was trained on; where the runner-up is
nearly as close, the text is flagged as ambiguous. Up to six languages use the exhaustive code (every
way to part them), more a fixed pseudo-random code.

Training counts come from every labelled training document, none sampled; the model has
``BUCKETS`` numbers a language whatever the size of the corpus. Defined results: null text and text
without a letter are ``und`` with score 0; ties go to the language that sorts first; repeated rows are
predicted each; an empty table, or one without labels, predicts ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homelens.llm import bytesets, columns

BUCKETS = 1 << 16
UNKNOWN = "und"
SURE = 0.6
STEP = 1 << 16
#: lower-case letters and bytes of longer characters stay; all else is a space
_CLASS = np.where(np.arange(256) >= 128, np.arange(256), np.where(np.isin(bytesets.LOWER, np.arange(97, 123)), bytesets.LOWER, 32)).astype(np.uint32)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two."""
    c = _CLASS[data]
    return (c[:-2] * np.uint32(63689) + c[1:-1] * np.uint32(378551) + c[2:] * np.uint32(2654435761)) >> np.uint32(7) & np.uint32(BUCKETS - 1)


def held_out(doc_id, parts: int, part: int):
    """Whether a document belongs to the held-out part; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class; no two rows alike."""
    if classes < 2:
        return np.ones((classes, 0))
    if classes <= 6:
        bits = np.arange(1, 2 ** (classes - 1))
        return np.where((np.concatenate([np.zeros((1, len(bits)), int), bits[None, :] >> np.arange(classes - 1)[:, None] & 1]) > 0), 1.0, -1.0)
    draw = np.random.default_rng(11)
    while True:
        code = draw.choice([-1.0, 1.0], (classes, int(np.ceil(10 * np.log2(classes)))))
        code = code[:, np.abs(code.sum(0)) < classes]
        if len(np.unique(code, axis=0)) == classes:
            return code


class Model:
    """Languages, their codewords and the bits' classifiers."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS) if len(languages) else counts
        weights = []
        for bit in self.code.T:
            weights.append(np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)))
        self.weights = np.array(weights).T.reshape(BUCKETS, self.code.shape[1]).astype(np.float32)
        margins = (share @ self.weights) * self.code if len(languages) > 1 else np.ones((len(languages), 0))
        self.trust = np.maximum(margins.min(0), 1e-6) if margins.shape[1] else np.ones(0)
        self.trust = self.trust / max(self.trust.max(initial=0), 1e-9)

    def decode(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its probability, whether the runner-up is close) from summed bit scores."""
        signal = sums / np.maximum(n, 1)[:, None] * np.minimum(n, 60)[:, None]
        loss = np.stack([(np.logaddexp(0, -signal * row) * self.trust).sum(1) for row in self.code], 1)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        return best, odds.max(1), odds.max(1) < SURE


def train(labelled: DataFrame) -> Model:
    """The model from all rows of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, data, offsets in bytesets.pieces(batch, "text"):
                if len(data) < 3:
                    continue
                grams = _trigrams(data)
                langs = np.array(rows.column("lang").to_pylist(), object)
                owner = np.repeat(np.arange(len(langs)), np.diff(offsets))[: len(grams)]
                inside = np.arange(len(grams)) + 2 < offsets[1:][owner]
                for lang in set(langs):
                    mine = inside & (langs == lang)[owner]
                    tables[lang] = tables.get(lang, 0) + np.bincount(grams[mine], minlength=BUCKETS)
        for lang, table in tables.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(table[used], pa.int64())], names=["lang", "bucket", "n"])

    sums = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.searchsorted(languages, found["lang"]) if len(found) else [], found["bucket"].to_numpy(int)] = found["n"]
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with the language, its score and whether it is ambiguous under ``names``; the text alone decides.

    Columns of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in names]
    kept, lettered_name = [f.name for f in fields], columns.free_name(docs, "_lettered")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows, data, offsets in bytesets.pieces(batch, "text", 1 << 20):
                n = np.maximum(np.diff(offsets) - 2, 0)
                sums = np.zeros((len(n), known.weights.shape[1]))
                grams = _trigrams(data) if len(data) >= 3 and known.weights.shape[1] else np.empty(0, np.uint32)
                first = np.minimum(offsets[:-1], len(grams))
                last = np.minimum(first + n, len(grams))
                for k in range(0, len(grams), STEP):
                    totals = np.zeros((min(STEP, len(grams) - k) + 1, known.weights.shape[1]))
                    np.cumsum(known.weights[grams[k : k + STEP]], axis=0, dtype=np.float64, out=totals[1:])
                    i, j = np.searchsorted(last, k, "right"), np.searchsorted(first, k + STEP)
                    sums[i:j] += totals[np.clip(last[i:j] - k, 0, len(totals) - 1)] - totals[np.clip(first[i:j] - k, 0, len(totals) - 1)]
                best, score, close = known.decode(sums, n) if known.languages else (np.zeros(len(n), int), np.zeros(len(n)), np.ones(len(n), bool))
                plain = ~rows.column(lettered_name).to_numpy(zero_copy_only=False).astype(bool) | (not known.languages)
                labels = [UNKNOWN if p else known.languages[b] for p, b in zip(plain, best, strict=True)]
                extra = [pa.array(labels, pa.string()), pa.array(np.where(plain, 0.0, score)), pa.array(close | plain)]
                yield pa.RecordBatch.from_arrays([rows.column(k) for k in kept] + extra, names=[*kept, *names])

    lettered = docs.select(*[F.col(f"`{k}`") for k in kept], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(lettered_name))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean"), strict=True))])
    return lettered.mapInArrow(label, schema)


def identify(docs: DataFrame, parts: int = 4, part: int = 2, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Train on the labelled documents outside the held-out part, then predict all of ``docs``."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    return predict(docs, train(labelled), names)


def op3_language_codes(spark, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score, ambiguous."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "lang", "text"))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
