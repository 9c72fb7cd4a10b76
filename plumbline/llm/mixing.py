"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Source s with n_s rows and weight w_s gets the rate T * w_s / (W * n_s), where T is the wanted number of rows and
W the sum of the weights of the sources at hand. A row's count is the inverse of the Poisson distribution
of that rate at a uniform number hashed from its id and the seed, so any run and any partitioning give the
same counts. A rate over RATE_STEP is split into equal parts, each with a hash of its own: the sum of
such counts is Poisson again, and no probability underflows. Each row is exploded by its count, and the copies
are dealt and sorted by a hash of id and copy number.

The table of rates has a row a source. It is broadcast below BROADCAST_SOURCES of them (counted first), else joined by shuffle.

Cases: a null source is a source of its own (weight: default_weight); a row without an id draws by its text; repeated rows draw the
same count and are each replicated; a source of weight 0 vanishes; a very long text is copied as it is; an empty table gives an
empty table; other columns are kept, whatever their names, but for one named copy_col, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fields, stash, whole_row

RATE_STEP = 16.0
TERMS = 96  # beyond this many copies a rate of RATE_STEP has less than 1e-40 of its mass
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(df: DataFrame, weights: dict[str, float], default_weight: float, target_rows: int | None, source_col: str) -> DataFrame:
    """mix_source, mix_steps and mix_cdf (the distribution of one part) of every source."""
    counts = df.groupBy(col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    w = F.lit(float(default_weight))
    for name, x in weights.items():
        w = F.when(F.col("mix_source") == name, float(x)).otherwise(w)
    counts = stash(counts.withColumn("w", w), "mix-counts")
    total = counts.agg(F.sum("n").alias("rows"), F.sum("w").alias("w")).first()
    wanted = float(target_rows if target_rows is not None else total["rows"] or 0)
    rate = F.lit(wanted) * F.col("w") / F.lit(float(total["w"] or 1.0)) / F.col("n")
    steps = F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_STEP)).cast("int")
    first = F.exp(-F.col("part"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("part") / k).alias("p"),
            (acc["c"] + acc["p"] * F.col("part") / k).alias("c"),
            F.concat(acc["all"], F.array(acc["c"] + acc["p"] * F.col("part") / k)).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    out = counts.withColumn("rate", rate).withColumn("mix_steps", steps).withColumn("part", F.col("rate") / F.col("mix_steps"))
    out = out.select("mix_source", "mix_steps", cdf.alias("mix_cdf"))
    return F.broadcast(out) if counts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else out


def mix_sources(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    target_rows: int | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str | None = "copy",
    text_col: str = "text",
) -> DataFrame:
    """The rows of df, each as often as drawn, in random order; copy_col (if named) counts the copies from 0."""
    r = rates(df, weights or {}, default_weight, target_rows, source_col)
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("mix_steps") - 1),
        F.lit(0),
        lambda n, step: n + F.size(F.filter("mix_cdf", lambda c: c < uniform(F.lit(str(seed)), F.col("mix_key"), step.cast("string")))),
    )
    # u of the first part is drawn once a row, outside the filter, since most sources have one part.
    one = F.size(F.filter("mix_cdf", lambda c: c < F.col("mix_u")))
    n = F.when(F.col("mix_steps") == 1, one).otherwise(drawn)
    nameless = F.concat(F.lit("text:"), F.md5(F.coalesce(col(text_col), F.lit("")))) if text_col in df.columns else F.lit("")
    rows = df.select(whole_row(df).alias("row"), col(source_col).alias("source"), F.coalesce(col(id_col).cast("string"), nameless).alias("mix_key"))
    joined = rows.join(r, F.col("source").eqNullSafe(F.col("mix_source")))
    joined = joined.withColumn("mix_u", uniform(F.lit(str(seed)), F.col("mix_key"), F.lit("0"))).withColumn("mix_n", n).filter("mix_n > 0")
    copies = joined.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), "mix_key", F.col("mix_copy").cast("string")))
    dealt = copies.withColumn("mix_order", order).repartition("mix_order").sortWithinPartitions("mix_order")
    return dealt.select(*fields("row", [c for c in df.columns if c != copy_col]), *([F.col("mix_copy").cast("long").alias(copy_col)] if copy_col else []))
