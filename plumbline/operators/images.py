"""Embedded images of HTML pages: extraction, duplicates, sizes, identities and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.batches import small_batches
from ..functions.scanner import jpeg_dims
from ..functions.text import data_uri_bytes, image_header, matches


def page_body(html: Column | str) -> Column:
    """From the literal <body> on, or the whole page, without script elements."""
    html = F.col(html) if isinstance(html, str) else html
    at = F.instr(html, "<body>")
    body = F.when(at > 0, F.substring(html, at, F.length(html))).otherwise(html)
    return F.regexp_replace(body, r"<script[\s\S]*?</script>", "")


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)


def extract(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row an <img>, in document order, with its decoded payload's hash, size and dimensions."""
    tags = df.select(id_col, F.posexplode(matches(page_body(html_col), r"<img\b[^>]*?>")).alias("idx", "tag"))
    attrs = tags.select(id_col, F.col("idx").cast("long").alias("idx"), attribute(F.col("tag"), "src").alias("src"), attribute(F.col("tag"), "alt").alias("alt"))
    held = attrs.withColumn("data", F.when(F.startswith("src", F.lit("data:image")), data_uri_bytes(F.col("src"))))
    # Only JPEG payloads go to Python, whose frame header stands behind other segments.
    small_batches(df.sparkSession)
    jpeg = F.hex(F.substring("data", 1, 2)) == "FFD8"
    walked = held.withColumn("jpeg", jpeg_dims(F.when(jpeg, F.col("data"))))
    dims = walked.withColumn("dims", F.when(jpeg, F.struct(F.lit("jpeg").alias("kind"), F.col("jpeg.w").alias("w"), F.col("jpeg.h").alias("h"))).otherwise(image_header(F.col("data"))))
    return dims.select(
        id_col, "idx", "src", "alt", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("nbytes"),
        F.when(F.col("data").isNotNull(), F.col("dims.kind")).alias("kind"), F.when(F.col("data").isNotNull(), F.col("dims.w")).alias("w"), F.when(F.col("data").isNotNull(), F.col("dims.h")).alias("h"),
    )


def not_embedded(images: DataFrame, id_col: str) -> DataFrame:
    return images.filter(~F.startswith("src", F.lit("data:"))).select(id_col, "idx", "src")


def broken(images: DataFrame, id_col: str) -> DataFrame:
    """Data images that do not decode, are of no known type or have no width."""
    return images.filter(F.startswith("src", F.lit("data:image")) & (F.col("sha").isNull() | (F.col("kind") == "?") | (F.col("w") == 0))).select(id_col, "idx")


def duplicate_bytes(images: DataFrame, id_col: str) -> DataFrame:
    """The same bytes under more than one label."""
    return images.filter("sha is not null").groupBy(id_col, "sha").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("alt").alias("n_alt")).filter("n > 1 and n_alt > 1")


def same_bytes(images: DataFrame, id_col: str) -> DataFrame:
    """The same bytes, whatever their labels."""
    return images.filter("sha is not null").groupBy(id_col, "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def findings(images: DataFrame, id_col: str) -> DataFrame:
    """subject_id, rule, severity of the blocking image rules; an image without a source counts for none."""
    held = images.filter("src <> ''")
    rules = {"non_embedded_images": not_embedded(held, id_col), "broken_images": broken(held, id_col), "dup_image_bytes": duplicate_bytes(held, id_col)}
    out = [found.select(F.col(id_col).alias("subject_id"), F.lit(name).alias("rule"), F.lit("error").alias("severity")) for name, found in rules.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def duplicate_sizes(images: DataFrame, id_col: str) -> DataFrame:
    """PNGs alike in dimensions and length."""
    return images.filter("kind = 'png'").groupBy(id_col, "w", "h", "nbytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reused_sources(images: DataFrame, id_col: str) -> DataFrame:
    """The same source again; a data URI is known by its first 120 characters and its length."""
    key = F.when(F.startswith("src", F.lit("data:")), F.concat(F.substring("src", 1, 120), F.lit("#"), F.length("src").cast("string"))).otherwise(F.col("src"))
    grouped = images.groupBy(id_col, key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("idx")).alias("idxs"))
    return grouped.filter("n > 1").select(id_col, "key", "n", F.array_join(F.transform("idxs", lambda x: x.cast("string")), ",").alias("idxs"))


def narrow(images: DataFrame, id_col: str, min_width: int = 200) -> DataFrame:
    """Images narrower than wanted, or whose header cannot be read."""
    return images.filter(F.col("kind").isNotNull() & ((F.col("kind") != "png") | (F.col("w") < min_width))).select(id_col, "idx", "kind", "w")


def identity(images: DataFrame, id_col: str) -> DataFrame:
    """Kind and number an image claims by its label alone, in the first form that occurs (with captions: scanner.image_identities)."""
    forms = [(kind, pattern if exact else f"(?i){pattern}") for kind, _, pattern, exact in fixed.IMAGE_NAMES]
    said = F.coalesce(*[F.when(F.regexp_like("alt", F.lit(p)), F.struct(F.lit(k).alias("kind"), F.regexp_extract("alt", p, 1).try_cast("long").alias("num"))) for k, p in forms])
    return images.withColumn("said", said).select(id_col, "idx", F.col("said.kind").alias("declared_kind"), F.col("said.num").alias("declared_num"))


def caption_sequence(df: DataFrame, id_col: str, html_col: str, caption: str = r"图\s*([0-9]+)[：:]") -> DataFrame:
    """Images and captions of a page in order: ord, is_img, num (of captions)."""
    events = matches(html_col, rf"<img\b[^>]*>|{caption.replace('(', '(?:')}", 0)
    rows = df.select(id_col, F.posexplode(events).alias("ord", "event"))
    is_img = F.startswith("event", F.lit("<img"))
    return rows.select(id_col, F.col("ord").cast("long").alias("ord"), is_img.alias("is_img"), F.when(~is_img, F.regexp_extract("event", caption, 1).try_cast("long")).alias("num"))


def images_per_caption(events: DataFrame, id_col: str) -> DataFrame:
    """Images since the last caption, at each caption."""
    w = Window.partitionBy(id_col).orderBy("ord")
    run = events.withColumn("seen", F.sum(F.col("is_img").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    caps = run.filter(~F.col("is_img"))
    return caps.select(id_col, "ord", "num", (F.col("seen") - F.coalesce(F.lag("seen").over(w), F.lit(0))).cast("long").alias("n_images"))


def caption_inversions(events: DataFrame, id_col: str) -> DataFrame:
    w = Window.partitionBy(id_col).orderBy("ord")
    return events.filter("num is not null").withColumn("before", F.lag("num").over(w)).filter("num < before").select(id_col, "before", F.col("num").alias("after"))


def caption_duplicates(events: DataFrame, id_col: str) -> DataFrame:
    return events.filter("num is not null").groupBy(id_col, "num").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def expected_diff(events: DataFrame, id_col: str, expected: int) -> DataFrame:
    """Caption numbers of 1..expected that a page lacks, and others that it has."""
    got = events.groupBy(id_col).agg(F.array_sort(F.collect_set("num")).alias("got"))
    want = F.sequence(F.lit(1).cast("long"), F.lit(expected).cast("long"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return got.select(id_col, joined(F.array_except(want, F.col("got"))).alias("missing"), joined(F.array_except(F.col("got"), want)).alias("extra")).filter("missing <> '' or extra <> ''")


def missing_figures(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Figures that the text refers to but that have no caption."""
    refs = df.select(id_col, F.explode(matches(html_col, r"图\s*([0-9]+)", 1)).alias("num")).distinct()
    caps = df.select(id_col, F.explode(matches(html_col, r"图\s*([0-9]+)\s*[：:．.、，]", 1)).alias("num")).distinct()
    return refs.join(caps, [id_col, "num"], "left_anti").select(id_col, F.col("num").cast("long").alias("num"))


def first_images(images: DataFrame, most: int) -> DataFrame:
    """The first images of each page; the audit's limit on images."""
    return images.filter(F.col("idx") < most)
