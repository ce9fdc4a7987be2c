"""The opN_ queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, chat, codes, lm, packing, pii, quality, simhash, spelling, suffixdedup, topk, toxicity, vectorjoin
from .common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeats_digest(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytebpe.encode_decode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorjoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.text_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffixdedup": op1_suffixdedup,
    "op2_toxicity": op2_toxicity,
    "op3_bytebpe": op3_bytebpe,
    "op4_vectors": op4_vectors,
    "op5_packing": op5_packing,
    "op6_chat": op6_chat,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_topk": op10_topk,
    "op11_spelling": op11_spelling,
    "op12_codes": op12_codes,
    "op13_lmscore": op13_lmscore,
}

ORACLES: dict[str, str] = {
    "op8_pii": pii.oracle(),
    "op10_topk": topk.oracle(),
    "op12_codes": codes.oracle(),
}
