"""The thin queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import jaccard, merkle, mixing, neighbours, quality, secrets, sharding, stamps, substrings, toxicity, urls, words
from groundwork.llm.common import spread, table
from groundwork.llm.pieces import encode_decode


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_pairs() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_at", urls.fetch_time(F.col("page_id")))
    return urls.judge(pages, urls.generated(spark))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.judged(documents, table(spark, sf_dir, "labels")).drop("text")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode_decode(documents, piece_model()).drop("text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return toxicity.scored(documents, table(spark, sf_dir, "labels")).drop("text")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.passages(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered(F.col("doc_id"), F.col("text"))))


def op12_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.encode_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), byte_pairs())


def op13_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.normalised(table(spark, sf_dir, "stamps"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_jaccard": op2_jaccard,
        "op3_urls": op3_urls,
        "op4_quality": op4_quality,
        "op5_neighbours": op5_neighbours,
        "op6_sharding": op6_sharding,
        "op7_pieces": op7_pieces,
        "op8_toxicity": op8_toxicity,
        "op9_substrings": op9_substrings,
        "op10_mixing": op10_mixing,
        "op11_merkle": op11_merkle,
        "op12_words": op12_words,
        "op13_stamps": op13_stamps,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.scan_sql(), "op2_jaccard": jaccard.JOIN_SQL, "op3_urls": urls.JUDGE_SQL, "op9_substrings": substrings.PASSAGES_SQL, "op10_mixing": mixing.MIX_SQL, "op11_merkle": merkle.MANIFEST_SQL, "op13_stamps": stamps.STAMPS_SQL}
