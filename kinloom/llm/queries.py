"""The registered queries op1 to op10 and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain_quality, crf_language, hash_tree, histogram_pack, multi_index_hash, prefix_bpe, rule_ledger, set_relation_join, string_kernel_toxicity, template_tree
from .common import read


def vocabulary(name: str) -> str:
    """Where the public vocabulary files are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = crf_language.held_out("doc_id", 3, 1)
    chain = crf_language.learn(docs, ~out)
    return crf_language.identify(docs, chain).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_texts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hash_tree.even_tree(24)
    return hash_tree.shard_documents(read(spark, sf_dir, "documents"), tree, hash_tree.grow(tree))


def op4_multi_index_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_hash.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), crf_language.held_out("doc_id", 5, 0)
    machine = string_kernel_toxicity.learn(docs, read(spark, sf_dir, "labels"), ~out)
    return string_kernel_toxicity.score(docs, machine).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_histogram_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_pack.pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rule_ledger.apply_policy(rule_ledger.ledger(read(spark, sf_dir, "documents")), "strict-1")
    return entries.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(rule_ledger.BASE_MASK).cast("long")) != 0)


def op8_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_relation_join.link_components(read(spark, sf_dir, "documents"), words=5, percent=75)


def op9_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = template_tree.dedup_lines(read(spark, sf_dir, "documents"))
    digest = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    return cleaned.select("doc_id", "n_lines", "n_dropped", "emptied", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("clean_chars"), digest.alias("clean_crc32"))


def op10_cotrain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), crf_language.held_out("doc_id", 5, 0)
    views = cotrain_quality.learn(docs, read(spark, sf_dir, "labels"), ~out)
    return cotrain_quality.score(docs, views).select("doc_id", out.alias("held_out"), "score", "text_score", "meta_score", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_crf_language": op1_crf_language,
        "op2_prefix_bpe": op2_prefix_bpe,
        "op3_hash_tree": op3_hash_tree,
        "op4_multi_index_hash": op4_multi_index_hash,
        "op5_string_kernel_toxicity": op5_string_kernel_toxicity,
        "op6_histogram_pack": op6_histogram_pack,
        "op7_rule_ledger": op7_rule_ledger,
        "op8_set_relation_join": op8_set_relation_join,
        "op9_template_tree": op9_template_tree,
        "op10_cotrain_quality": op10_cotrain_quality,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.ORACLES
