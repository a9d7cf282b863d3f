"""The queries of this subpackage: thin digests over the operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("text")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    df = scan_secrets(_read(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import canonical, filter_urls, host_of, path_of

    pages = _read(spark, sf_dir, "pages")
    # the list: canonical URLs of blogs and of the hosts that are named for spam, pills or bets
    listed = pages.where(host_of(F.col("url")).rlike(r"(^|\.)(spam-farm|cheap-pills|free-bets|blog)\.")).select(
        canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("canon")
    )
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    df = remove_repeats(_read(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepieces import encode_documents

    df = encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    df = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return df.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents")).drop("detections")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align_documents

    files = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align_documents(_read(spark, sf_dir, "documents"), *files, derive={"groups_sha256": digest})


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencounts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLE

    return dict(ORACLE)
