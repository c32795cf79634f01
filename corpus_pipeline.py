"""The corpus pipeline: language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last give the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.llm.jaccard_join import keep_one_of_each
from tabassay.llm.language import UNKNOWN, identify, learn
from tabassay.llm.packing import pack, token_pieces
from tabassay.llm.secret_scan import mask_secrets
from tabassay.llm.tables import fresh, read_table
from tabassay.session import fresh_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; null texts and texts without a letter go, no others do."""
    model = learn(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model)
    return docs.filter(found["lang"] != UNKNOWN)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word shingle similarity of 0.8 or more."""
    return keep_one_of_each(docs, words=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and ``n_chars`` kept true."""
    before = fresh(docs, "text_before")
    masked = mask_secrets(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(before))
        length = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        masked = masked.withColumn("n_chars", length)
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]
# A learned language model and an encoder are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
