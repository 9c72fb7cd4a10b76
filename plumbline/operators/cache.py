"""A content-hash block cache as an append-only log: the last write of a block counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, tokens
from ..schemas import PROFILE_KEYS


def profile_violations(profiles: DataFrame) -> DataFrame:
    """Required profile keys that are missing or blank; profile is a map of strings."""
    key = F.explode(F.array(*map(F.lit, PROFILE_KEYS))).alias("key")
    return profiles.select("cache_id", "profile", key).filter(blank(F.try_element_at("profile", F.col("key")))).select("cache_id", "key")


def input_key(hashes: Column) -> Column:
    """The key of a cache: a hash over its sorted input hashes."""
    return F.sha2(F.array_join(F.array_sort(hashes), ","), 256)


def changed_inputs(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded inputs (path, sha256) whose present hash differs or that are gone."""
    now = current.select("path", F.col("sha256").alias("now"))
    return recorded.join(now, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", "sha256", "now")


def put(blocks: DataFrame) -> DataFrame:
    """Log rows for (block_id, seq, source, translation, validated): a block with issues cannot be validated and is rejected."""
    issues = F.array_compact(F.array(F.when(blank("translation"), F.lit("empty_translation")), F.when(tokens("source") != tokens("translation"), F.lit("protected_tokens_changed"))))
    out = blocks.withColumn("issues", issues)
    status = F.when(blank("source"), "rejected").when(F.col("validated") & (F.size("issues") > 0), "rejected").when(F.col("validated"), "validated").otherwise("needs_review")
    return out.select("block_id", "seq", F.sha2("source", 256).alias("source_sha256"), "translation", F.sha2("translation", 256).alias("translation_sha256"), status.alias("status"), F.array_join("issues", ",").alias("issues"))


def latest(log: DataFrame, key: str = "block_id", seq: str = "seq") -> DataFrame:
    """The last accepted row of each block, by a partial aggregate rather than a sort of each block's history."""
    rest = [c for c in log.columns if c not in (key, seq)]
    accepted = log.filter("status <> 'rejected'")
    return accepted.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in (seq, *rest)])


def probe(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """hit, miss or corrupt for each wanted (block_id, source_sha256)."""
    b = blocks.select("block_id", F.col("source_sha256").alias("had"), "status", "translation", "translation_sha256")
    hit = (F.col("status") == "validated") & (F.col("had") == F.col("source_sha256"))
    sound = F.sha2("translation", 256) == F.col("translation_sha256")
    outcome = F.when(F.coalesce(~hit, F.lit(True)), "miss").when(sound, "hit").otherwise("corrupt")
    return wanted.join(b, "block_id", "left").select("block_id", outcome.alias("outcome"))


def summary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def ledger_conflicts(ledger: DataFrame) -> DataFrame:
    """Requests answered with different responses."""
    return ledger.groupBy("doc_id", "request_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("response_sha256").alias("n_responses")).filter("n_responses > 1")


def ledger_accepted(ledger: DataFrame) -> DataFrame:
    """The first response to each request; later equal ones change nothing."""
    return ledger.groupBy("doc_id", "request_id").agg(F.min(F.struct("seq", "response_sha256")).alias("x")).select("doc_id", "request_id", "x.seq", "x.response_sha256")
