"""The thin queries over the driver's tables: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import html_extract, media, minhash, mixing, packing, prefix_trie, quality, recurrent_lm, sharding, substring, token_counts, topk, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text, counted by the compiled transducer."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target shares."""
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a motion-JPEG file and described from what is read back."""
    return media.digests(table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of 50 words or more that each document shares with an earlier one."""
    return substring.shared_passages(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a shingle similarity of 0.75."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the co-trained views, and whether it is kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability by a recurrent model trained on six sevenths of them, beside a unigram base."""
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations as a node of a trie."""
    return prefix_trie.conversation_nodes(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a code of 8 parts, each the nearest of 16 entries learned in 6 rounds."""
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_html": op3_html,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_media": op6_media,
    "op7_substring": op7_substring,
    "op8_minhash": op8_minhash,
    "op9_topk": op9_topk,
    "op10_quality": op10_quality,
    "op11_recurrent_lm": op11_recurrent_lm,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op8_minhash": minhash.ORACLE, "op9_topk": topk.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
