"""The ten corpus queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, neardup, oracles, quality, sharding, substrings, suffixes, tokens, urls
from .common import table

TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SOURCE_WEIGHTS = {"src0": 4.0}  # every other source weighs 1
MIX_SEED = 17
N_SHARDS, SHARD_SLOTS = 32, 4099


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, seed=MIX_SEED)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", (langid.key_crc(found, "doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), N_SHARDS, SHARD_SLOTS)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.quality(quality.QualityRules()),
    "op3_url_filter": oracles.url_filter(URL_RULES),
    "op4_decontamination": oracles.decontamination(decontam.WINDOW),
    "op5_mix_sources": oracles.mixing(SOURCE_WEIGHTS, MIX_SEED),
    "op6_near_dedup": oracles.near_dedup(3, 85),
    "op9_sharding": oracles.sharding(N_SHARDS, SHARD_SLOTS),
    "op10_substring_dedup": oracles.word_windows(substrings.WINDOW),
}

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_mix_sources": op5_mix_sources,
    "op6_near_dedup": op6_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "op10_substring_dedup": op10_substring_dedup,
}
