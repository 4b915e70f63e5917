"""From raw documents to token ids: five operators in a row.

Each stage reads what the one before it kept, is written as Parquet in the run's
shared folder and read again by the next.

1. language: documents whose language can't be told (null, or no letter) go.
2. exact dedup: of equal texts, the smallest doc_id stays.
3. SimHash near-dedup: of each component, the document that names it stays.
4. decontamination: documents of which a benchmark covers a twentieth go.
5. SentencePiece: what is left, as piece ids, checked by decoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkprobe.llm import decontaminate, exact_dedup, language, queries, sentencepieces, simhash
from inkprobe.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_and_decode(docs, queries.PIECES)


STAGES: list[tuple[str, Stage]] = [
    ("language", tell_language),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

# Kernel ridge regression, XXH64 and Viterbi search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
