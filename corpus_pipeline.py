"""From raw documents to a deduplicated, clean, mixed and sharded corpus, in five stages.

Each stage takes (spark, docs, sf_dir), with at least the columns of documents, and returns what it keeps; all but the last return the
columns of docs, whatever further ones there are and however they are named. Empty tables give empty tables. A null or empty text is told
no language, so the first stage drops it; later stages, given one, keep it: it resembles nothing and holds no benchmark. Very long
texts are handled whole, one in a task. Ties and repeats: of equal rows near_dedup keeps one; rows of one id with different texts are
judged apart in all stages; mixing replicates each row it gets, and equal ids go to one shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, langid, mixing, neardup, sharding
from plumbline.llm.common import fields, stash, table, whole_row
from plumbline.llm.queries import MIX_SEED, N_SHARDS, SHARD_SLOTS, SOURCE_WEIGHTS

MIN_LANG_SCORE = 0.5
MIN_KNOWN = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of MIN_LANG_SCORE at least and knows MIN_KNOWN of their words.

    The model learns from the labelled rows of docs; lang is no input of a decision. A text without a letter goes.
    """
    found = langid.identify(docs, langid.train(docs), whole_rows=True)
    known = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANG_SCORE) & (F.col("known") >= MIN_KNOWN))
    return known.select(*fields("row", docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (a null one last), of one id the first by text hash.

    Documents are told apart by id and text, so an id that stands on two texts stands for two documents; of equal rows one is kept.
    """
    rows_of_id, named = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.min(F.col("doc_id").isNotNull())).first()
    key = F.col("doc_id")  # enough where every row has an id of its own
    if (rows_of_id or 1) > 1 or named is False:
        key = F.struct(key.isNull().alias("nameless"), F.coalesce(key, F.lit(0)).alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    keyed = docs.select(whole_row(docs).alias("row"), F.col("text").alias("text"), key.alias("key"))
    groups = neardup.near_duplicates(keyed.select("key", "text"), shingle=SHINGLE_WORDS, percent=SIMILAR_PERCENT, id_col="key")
    fates = groups.groupBy(F.col("key").alias("of")).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).filter("not kept or rows > 1")
    fates = stash(fates.select("of", "kept"), "fates")
    rows = keyed.select("row", "key")
    single = rows.join(fates, F.col("key") == F.col("of"), "left_anti").select("row")
    # Equal rows but one go here: partial aggregation keeps one a task before any shuffle.
    repeated = rows.join(fates.filter("kept"), F.col("key") == F.col("of"), "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select(*fields("row", docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark, however long they are; op4's share of hit words is not asked for here."""
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), whole_rows=True)
    return judged.filter(F.col("n_hit") == 0).select(*fields("row", docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in random order; a null source is a source of its own."""
    return mixing.mix_sources(docs, SOURCE_WEIGHTS, seed=MIX_SEED, copy_col=None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard; a null id is placed as an empty one, and a column named shard is replaced."""
    return sharding.assign_shards(docs, N_SHARDS, SHARD_SLOTS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix_sources", mix_sources), ("shard", shard)]

# Language identification and MinHash have no SQL form; tests/llm compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
