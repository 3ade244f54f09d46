"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_trie, decontaminate, embed_dup, html_text, lm_score, near_dup, oracles, piece_bpe, quality, repeats, secrets, sharding, spelling

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain test items: a row per pair, with the item's shingles and how many of them are found."""
    found = decontaminate.contained(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir))
    pairs = found.select("doc_id", F.explode("leaks").alias("leak"))
    return pairs.select("doc_id", F.col("leak.item").alias("item_id"), F.col("leak.n_shingles").cast("long").alias("n_shingles"), F.col("leak.n_common").cast("long").alias("n_common"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to, as digests."""
    return piece_digests(piece_bpe.encode_decode(documents(spark, sf_dir), PIECES))


def piece_digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


LM_ORDER = 2


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; one in seven is held out by a checksum of its id."""
    learned = "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) <> 2"
    return lm_score.score(documents(spark, sf_dir), learned, LM_ORDER)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text."""
    return byte_bpe.count_tokens(documents(spark, sf_dir), BYTES)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and verdict of every document."""
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.quality(documents(spark, sf_dir)).select("row.doc_id", *base)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every page."""
    return html_text.extract(pages(spark, sf_dir), html_text.trained(pages(spark, sf_dir)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the 50-byte strings of documents with smaller ids."""
    return repeats.remove_repeats(documents(spark, sf_dir), digest=True)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = [_of_kind(i).alias(f"n_{k}") for i, k in enumerate(secrets.BASE)]
    base = secrets.spelled(F.filter("secrets", lambda s: s["kind"] < len(secrets.BASE)))
    return found.select("doc_id", *count, F.sha2(base, 256).alias("base_sha256"), secrets.spelled(F.col("secrets")).alias("spans"))


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(documents(spark, sf_dir), 40)


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return embed_dup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_lm_score": op3_lm_score,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
    "op11_embedding_duplicates": op11_embedding_duplicates,
    "op12_spelling": op12_spelling,
    "op13_conversation_trie": op13_conversation_trie,
}
#: The others are checked against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op1_decontamination": oracles.OP1,
    "op5_near_duplicates": oracles.OP5,
    "op6_quality": oracles.OP6,
    "op9_secrets": oracles.OP9,
    "op11_embedding_duplicates": oracles.OP11,
    "op12_spelling": oracles.OP12,
    "op13_conversation_trie": oracles.OP13,
}
