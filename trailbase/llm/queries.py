"""Queries over the documents, embeddings and conversations tables, one for each operator here, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, near_dup, packing, piece_codec, prefix_trie, radix_dedup, ranker, rules, secrets, suffix_dedup, suffix_tree_dedup, token_rollup, weighted_lloyd


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: two-word shingles, similarity 0.8 or more."""
    return near_dup.components(spark, table(spark, sf_dir), 2, 80)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    return piece_codec.digest_documents(table(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return radix_dedup.exact_groups(spark, table(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack(spark, table(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that an earlier one has."""
    return suffix_dedup.remove(spark, table(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents, and whether the rules keep them."""
    return rules.apply_rules(spark, table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents, by two tokenizers, after batches of inserts, deletes and revisions."""
    versions = {name: tokenizer(name) for name in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")}
    return token_rollup.replay(spark, table(spark, sf_dir), table(spark, sf_dir, "labels"), versions)


def word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of op7 by two rules for words, which SQL can count."""
    return token_rollup.replay(spark, table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return ranker.score_documents(spark, table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 20-word windows that occur earlier."""
    return suffix_tree_dedup.remove(spark, table(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.report(table(spark, sf_dir))


def op11_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all embeddings after three rounds."""
    return weighted_lloyd.cluster(spark, table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all rebuilt conversations."""
    return prefix_trie.family_trie(spark, table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back."""
    return chat_format.with_marked(spark, table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"word_rollup": word_rollup}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_radix_dedup": radix_dedup.ORACLE_SQL, "word_rollup": token_rollup.ORACLE_SQL, "op11_weighted_lloyd": weighted_lloyd.oracle_sql(),
        "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_chat_format": chat_format.ORACLE_SQL,
    }
