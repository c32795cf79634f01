"""Queries that apply each corpus operator to its whole table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from tabassay.llm.byte_bpe import ByteBpe, map_encoded
from tabassay.llm.filter_audit import audit_filters
from tabassay.llm.hamming_search import nearest_codes, sign_code
from tabassay.llm.jaccard_join import similar_components
from tabassay.llm.language import held_out, identify, learn
from tabassay.llm.license_scan import scan_licenses
from tabassay.llm.main_text import extract_main_text
from tabassay.llm.oracle import AUDIT, COSINE, HAMMING, JACCARD, LEAKS, RESAMPLING, licenses
from tabassay.llm.packing import pack, token_pieces
from tabassay.llm.resampling import resample
from tabassay.llm.secret_scan import find_secrets, joined
from tabassay.llm.sharding import shard_by_ring
from tabassay.llm.tables import read_table
from tabassay.llm.vector_dedup import near_copies
from tabassay.llm.winnowing import contamination


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on eight shards whose rows differ by one at most."""
    placed = shard_by_ring(read_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home",
    )


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, counted and listed by place."""
    found = find_secrets(read_table(spark, sf_dir, "documents"))

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every fiftieth embedding among all embeddings."""
    codes = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", sign_code("embedding").alias("code")
    )
    return nearest_codes(codes, codes.filter("vec_id % 50 = 0"), k=10)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by shingle similarity of 0.9 or more."""
    return similar_components(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select("doc_id", identify(docs, learn(docs)).alias("found"))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and statements in all documents."""
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    own = F.transform("places", lambda p: p["label"])
    return scan_licenses(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = extract_main_text(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings."""
    return near_copies(read_table(spark, sf_dir, "embeddings"))


def _digests(coder: ByteBpe, ids: bytes) -> tuple[int, str, str]:
    listed = " ".join(map(coder.decimal.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
    return (
        len(ids) // 4,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(coder.decode(ids)).hexdigest(),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    columns = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents")
    return map_encoded(docs, ranks, public_tokenizers.PATTERN, _digests, columns)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack(token_pieces(read_table(spark, sf_dir, "documents"), vocabulary))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark, a quarter of the longer ones drawn."""
    docs, target = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample(docs, target).drop("n_words")


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in all documents."""
    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders."""
    return audit_filters(*(read_table(spark, sf_dir, t) for t in ("documents", "labels")))


CHECKS = {
    "op1_bounded_ring": (op1_bounded_ring, None),
    "op2_secret_scans": (op2_secret_scans, None),
    "op3_topk_search": (op3_topk_search, HAMMING),
    "op4_jaccard_join": (op4_jaccard_join, JACCARD),
    "op5_language_id": (op5_language_id, None),
    "op6_license_scans": (op6_license_scans, licenses()),
    "op7_html_extraction": (op7_html_extraction, None),
    "op8_embedding_dedup": (op8_embedding_dedup, COSINE),
    "op9_byte_bpe": (op9_byte_bpe, None),
    "op10_best_fit_packing": (op10_best_fit_packing, None),
    "op11_importance_resampling": (op11_importance_resampling, RESAMPLING),
    "op12_benchmark_decontamination": (op12_benchmark_decontamination, LEAKS),
    "op13_filter_audit": (op13_filter_audit, AUDIT),
}
