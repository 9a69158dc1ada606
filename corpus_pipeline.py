"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homelens.llm import columns, langid, lines, mixing, packing, setjoin, storage
from homelens.llm.sizing import text_bytes


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known and not ambiguous."""
    names = tuple(columns.free_name(docs, n) for n in ("_lang", "_sure", "_unclear"))
    found = langid.identify(docs, names=names)
    return found.filter((F.col(names[0]) != langid.UNKNOWN) & ~F.col(names[2])).select(*_own(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts; documents that lose every line they had go."""
    gone, kept = (columns.free_name(docs, n) for n in ("_gone", "_kept"))
    found = lines.dedup_lines(docs, (gone, kept))
    left = F.coalesce(F.col(kept).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    changed = found.filter(F.col(gone).isNull() | left).withColumn("text", F.col(kept))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of each component of near copies: the smallest doc_id, those without one last, then by text.

    Rows with one doc_id and text are one document read twice; rows without doc_id and without shingles all stay.
    """
    found = setjoin.row_components(docs, 80, 5)
    own = F.struct(F.col("doc_id").isNull().alias("idless"), "doc_id", "tid")
    first = found.filter(F.col("component") == own).select(*setjoin.own_key(F.col("doc_id"), F.col("tid")), (F.col("doc_id").isNull() & (F.col("n") == 0)).alias("_each")).distinct()
    first = storage.materialize(first, "first-copies")
    keys = ["_idless", "_own", "_tid"]
    keyed = columns.packed(docs, "doc_id", "text").select("*", *setjoin.own_key(F.col("doc_id").cast("long"), setjoin.text_key()))
    kept = keyed.join(first.hint("merge"), keys).withColumn("_nth", F.when(F.col("_each"), F.monotonically_increasing_id()).otherwise(0))
    return columns.unpacked(kept.dropDuplicates([*keys, "_nth"]), docs, "doc_id", "text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents as often as its target weight asks for."""
    return mixing.mixed_documents(docs, text_bytes(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("best_fit_packing", sequences),
]
#: language prediction by a trained classifier has no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
