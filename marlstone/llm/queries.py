"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, crosspoly, decontam, langid, lexical, mixing, ngramjoin, pii, sharding, suffixes, tokens, toxicity
from .base import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid_digest(table(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_personal_data(docs))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_langid, op2_embeddings, op3_ngram_join, op4_toxicity, op5_sharding, op6_chat, op7_mixing, op8_decontam, op9_pii, op10_tokens,
        op11_repeats, op12_lexical, op13_alignment,
    )
}

SQL: dict[str, str] = {"op2_embeddings": crosspoly.SQL, "op3_ngram_join": ngramjoin.SQL, "op6_chat": chat.SQL, "op12_lexical": lexical.SQL}
