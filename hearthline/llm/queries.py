"""The registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import backoff_automaton, byte_bpe, decontamination, host_trust, near_copies, page_text, pair_alignment, prefix_trie, ranked_search, segment_search, shard_packing, token_count, toxicity
from hearthline.registered.base import Query, table


def op1_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.main_texts(table(spark, folder, "pages"))


def op2_host_trust(spark: SparkSession, folder: str) -> DataFrame:
    return host_trust.judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)


def op5_shard_packing(spark: SparkSession, folder: str) -> DataFrame:
    return shard_packing.shard_rows(table(spark, folder, "documents"), shards=40)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digest_texts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_backoff_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_automaton.score_texts(table(spark, folder, "documents"))


def op8_segment_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return segment_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


def op10_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.near_copies(table(spark, folder, "documents"), size=4, percent=80)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.linked_texts(table(spark, folder, "documents"), size=4, percent=85)


def op12_presence_masks(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


def op13_pair_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    return pair_alignment.align_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_page_text, op2_host_trust, op3_decontamination, op4_toxicity, op5_shard_packing, op6_byte_bpe, op7_backoff_automaton, op8_segment_search, op9_token_counts, op10_near_copies, op11_prefix_trie, op12_presence_masks, op13_pair_bitmaps)}
ORACLE: dict[str, str] = {"op2_host_trust": host_trust.oracle(), "op8_segment_search": segment_search.oracle(10), "op10_near_copies": near_copies.oracle(4, 80), "op11_prefix_trie": prefix_trie.oracle(4, 85), "op12_presence_masks": ranked_search.oracle(50)}
