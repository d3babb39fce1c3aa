"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusqa.llm import decontam, jaccard, linededup, neardup, packing, quality, sharding, spelling, tokenfile, toxicity, trie, urltree, warc
from corpusqa.llm.shared import crc_of, table

#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), hold=(3, 1))
    return toxicity.score(docs, lexicon).select("doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "score", "predicted", "n_hits")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), hold=(4, 2))
    return quality.score(docs, model).select("doc_id", (crc_of("doc_id") % 4 == 2).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.new_folder(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json"))
    return tokenfile.read(spark, folder)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return out.select("doc_id", "n_bytes", "shard", "shard_depth", "shard_part")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=1000)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), group=20, heads=4)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least=6, often=5, slip=199, ratio=5)


REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_shingle_join": op5_shingle_join,
    "op6_near_vectors": op6_near_vectors,
    "op7_decontamination": op7_decontamination,
    "op8_url_filter": op8_url_filter,
    "op9_token_files": op9_token_files,
    "op10_sharding": op10_sharding,
    "op11_warc": op11_warc,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op3_line_dedup": linededup.SQL,
    "op5_shingle_join": jaccard.sql(3, 90, 100),
    "op6_near_vectors": neardup.SQL,
    "op10_sharding": sharding.sql(SHARD_BYTES),
    "op11_warc": warc.SQL,
    "op12_conversation_trie": trie.SQL,
    "op13_spelling_variants": spelling.SQL,
}
