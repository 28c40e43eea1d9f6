"""A corpus pipeline of five stages, each over all rows that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents; further columns of docs pass through every stage, whatever their names
are.  An empty table gives no rows in any stage, and texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import crc_mod, saved, table
from tesserae.llm.language import identify
from tesserae.llm.mixing import mixed
from tesserae.llm.ngram_join import jaccard_components
from tesserae.llm.packing import pack_along_curve
from tesserae.llm.secrets_scan import findings, redacted, scan

_DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its further columns under names that no operator uses, and what names them back."""
    names = docs.columns
    plain = docs.toDF(*(c if c in _DOCUMENT else f"further_{k}" for k, c in enumerate(names)))
    return plain, lambda out: out.select(*plain.columns).toDF(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a margin; those that are rejected go.

    Null texts, texts without letters, ties and narrow margins are rejected.  Repeated
    rows stay or go together.
    """
    docs, back = _set_aside(docs)
    usable = F.coalesce(crc_mod(F.col("doc_id"), 5) != 0, F.lit(True))
    return back(identify(docs, usable).where("accepted"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group at five words and similarity 0.8.

    Of rows with one doc_id one stays, and none if all of them have an earlier copy; rows
    without a doc_id can't be compared and stay.  Texts without words are alike to none.
    """
    docs, back = _set_aside(docs)
    found = jaccard_components(docs, width=5, num=8, den=10, mark=F.xxhash64("text"))
    kept = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("k_id")).agg(F.min("mark").alias("k_mark"))
    held = docs.join(kept, (F.col("doc_id") == F.col("k_id")) & (F.xxhash64("text") == F.col("k_mark")))
    return back(held.dropDuplicates(["k_id", "k_mark"]).select(*docs.columns).union(docs.where("doc_id is null")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret found is masked, and n_chars counts the text as it is then.

    Null and empty texts hold none; a document without findings is returned as it is.
    """
    docs, back = _set_aside(docs)
    found = findings(docs, scan(docs))
    some = F.size("spans") > 0
    text = F.when(some, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(changed)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by their calibrated probabilities.

    Null sources, languages and texts are values of their own; equal rows go together.
    """
    docs, back = _set_aside(docs)
    return back(mixed(docs).where("selected"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end id alone."""
    import public_tokenizers

    return pack_along_curve(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=200_000, keep=False)  # workers live on in other stages


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
