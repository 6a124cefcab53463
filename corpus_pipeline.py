"""A training corpus from raw documents: language ID, exact dedup, near-dedup, mixing and BPE coding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
Between stages the rows are written as Parquet in the folder that driver and executors share, and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlift.llm import bpe, exact_dedup, lang_id, minhash, mixing
from ledgerlift.llm.common import discard, stored

#: Least score of a document's language; texts without a letter have none and go too.
LEAST_SCORE = 0.5
#: Least similarity of near-copies, in percent of their five-word shingles.
NEAR = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told surely enough; the model learns from the documents' own labels."""
    model = lang_id.fit(docs.where(lang_id.remainder(3) != 1))
    return lang_id.keep_languages(docs, model, LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def code_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for every row of the mix."""
    import public_tokenizers

    return bpe.code(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", code_texts),
]

#: Language ID, sketching and BPE are not expressible in SQL; tests hold run() against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*held)  # nothing reads the stage before any more
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
