"""Rectangles, candidate regions and the verdicts on measured images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def locate(boxes: DataFrame, regions: DataFrame, slack: float = 6.0) -> DataFrame:
    """The smallest region of its page that holds a box's centre, within the slack.

    boxes: doc_id, page, box, x0, y0, x1, y1; regions: doc_id, page, ord, kind, num, x0, y0, x1, y1.
    """
    b = boxes.select("doc_id", "page", "box", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    r = regions.select("doc_id", "page", "ord", "kind", "num", "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    inside = F.col("cx").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("cy").between(F.col("y0") - slack, F.col("y1") + slack)
    best = b.join(r, ["doc_id", "page"]).filter(inside).groupBy("doc_id", "page", "box").agg(F.min(F.struct("area", "ord", "kind", "num")).alias("best"))
    return best.select("doc_id", "page", "box", F.col("best.kind").alias("kind"), F.col("best.num").alias("num"))


def declared(images: DataFrame, regions: DataFrame, most: int = 3) -> DataFrame:
    """The first regions that carry an image's declared kind and number."""
    j = images.select("doc_id", "box", F.col("declared_kind").alias("kind"), F.col("declared_num").alias("num")).join(regions.select("doc_id", "kind", "num", "ord"), ["doc_id", "kind", "num"])
    w = Window.partitionBy("doc_id", "box").orderBy("ord")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most).select("doc_id", "box", "ord", "rank")


def top_candidates(scores: DataFrame, most: int = 3) -> DataFrame:
    """The best scored regions of each image; the earlier region wins a tie."""
    w = Window.partitionBy("doc_id", "box").orderBy(F.desc("score"), "ord")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most)


def ambiguous(scores: DataFrame, floor: float = 0.0015, factor: float = 2.5) -> DataFrame:
    """Images whose runner-up is another region and nearly as good (scores are distances)."""
    w = Window.partitionBy("doc_id", "box").orderBy("sqdiff", "ord")
    first = scores.withColumn("rank", F.row_number().over(w)).withColumn("next_sqdiff", F.lead("sqdiff").over(w)).withColumn("next_ord", F.lead("ord").over(w)).filter("rank = 1")
    near = (F.col("next_ord") != F.col("ord")) & (F.col("next_sqdiff") < F.greatest(F.lit(floor), F.lit(factor) * F.col("sqdiff")))
    return first.filter(near).select("doc_id", "box", "ord", "next_ord")


def coverage(regions: DataFrame, matched: DataFrame) -> DataFrame:
    """Regions without an image, and regions with several."""
    m = matched.groupBy("doc_id", "kind", "num").agg(F.count(F.lit(1)).alias("n"))
    j = regions.select("doc_id", "kind", "num").distinct().join(m, ["doc_id", "kind", "num"], "left")
    state = F.when(F.col("n").isNull(), "uncovered").when(F.col("n") > 1, "duplicated")
    return j.withColumn("state", state).filter("state is not null").select("doc_id", "kind", "num", "state")


def crop_tops(captions: DataFrame, top: float = 40.0) -> DataFrame:
    """Where the crop above a caption begins: the end of the caption before it in its column."""
    w = Window.partitionBy("doc_id", "page", "col").orderBy("y0", "num")
    return captions.withColumn("top", F.coalesce(F.lag("y1").over(w), F.lit(top)))


def crop_boxes(zones: DataFrame, blocks: DataFrame, wide: float = 0.55) -> DataFrame:
    """The union of the image blocks in a caption's zone, or the whole zone where they are too narrow.

    zones: doc_id, page, num, x0, x1, top, bottom; blocks: doc_id, page, x0, y0, x1, y1.
    """
    b = blocks.select("doc_id", "page", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    z = zones.join(b, ["doc_id", "page"], "left")
    inside = (F.col("bx0") >= F.col("x0") - 1) & (F.col("bx1") <= F.col("x1") + 1) & (F.col("by0") >= F.col("top")) & (F.col("by1") <= F.col("bottom"))
    pick = lambda f, c: f(F.when(inside, F.col(c)))
    g = z.groupBy("doc_id", "page", "num", "x0", "x1", "top", "bottom").agg(pick(F.min, "bx0").alias("ux0"), pick(F.min, "by0").alias("uy0"), pick(F.max, "bx1").alias("ux1"), pick(F.max, "by1").alias("uy1"))
    use = F.coalesce((F.col("ux1") - F.col("ux0")) >= wide * (F.col("x1") - F.col("x0")), F.lit(False))
    return g.select("doc_id", "page", "num", F.when(use, F.col("ux0")).otherwise(F.col("x0")).alias("x0"), F.when(use, F.col("uy0")).otherwise(F.col("top")).alias("y0"), F.when(use, F.col("ux1")).otherwise(F.col("x1")).alias("x1"), F.when(use, F.col("uy1")).otherwise(F.col("bottom")).alias("y1"))


def candidate_rects(anchors: DataFrame) -> DataFrame:
    """The rectangle that an item's image would come from: the line of an equation number, the column above a caption.

    anchors: doc_id, page, kind, num, x0, y0, x1, y1 and width (of the page), in points.
    """
    c = F.col
    is_eq = c("kind") == "eq"
    sides = {
        "x0": (c("width") * 0.04, F.greatest(F.lit(0.0), c("x0") - 10)),
        "y0": (c("y0") - 46, F.greatest(F.lit(0.0), c("y0") - 400)),
        "x1": (c("x1") + 18, F.least(c("width"), c("x1") + 10)),
        "y1": (c("y1") + 26, c("y1") + 2),
    }
    return anchors.select("doc_id", "page", "kind", "num", *[F.round(F.when(is_eq, eq).otherwise(other), 1).alias(name) for name, (eq, other) in sides.items()])


def largest(boxes: DataFrame, keys: list[str], size: Column, most: int = 6) -> DataFrame:
    """The largest rows of each key with their rank; the earlier (ord) of equals first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("size"), "ord")
    return boxes.withColumn("size", size).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most)


def to_points(px: Column, dpi: float) -> Column:
    return px * F.lit(72.0) / F.lit(float(dpi))


def ratio_rect(width: Column, height: Column, box: list[float]) -> list[Column]:
    """A rectangle given in shares of the page, in points."""
    return [F.bround(width * box[0], 1), F.bround(height * box[1], 1), F.bround(width * box[2], 1), F.bround(height * box[3], 1)]


def band(sqdiff: Column) -> Column:
    return F.when(sqdiff.isNull(), "unknown").when(sqdiff <= 0.0003, "clean").when(sqdiff <= 0.0092, "minor").when(sqdiff <= 0.16, "suspect").otherwise("nonmatch")


# Shares of missing and of extra ink above which a difference is real, by kind of image.
INK_LIMITS = {"lineart": (0.05, 0.05), "halftone": (0.35, 0.35), "unknown": (0.20, 0.20)}
DECLARED_OK = 0.020
PAGE_SHARE = 0.45
VANISHED_AREA = 40
STRETCHY_MISSING = 0.02
LOW_CORRELATION = 0.70


def ink_limit(img_type: Column, extra: bool) -> Column:
    """The limit of missing or of extra ink for a kind of image; other kinds have that of unknown ones."""
    out = F.lit(INK_LIMITS["unknown"][extra])
    for name in ("lineart", "halftone"):
        out = F.when(img_type == name, INK_LIMITS[name][extra]).otherwise(out)
    return out


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def slot_mismatch(declared_kind: Column, declared_num: Column, hit_kind: Column, hit_num: Column, ambiguous: Column) -> Column:
    """Whether an image certainly shows another item of the kind that it is declared to show."""
    return _true((declared_kind == hit_kind) & (declared_num != hit_num) & (declared_num != 0) & ~F.coalesce(ambiguous, F.lit(False)))


#: severity, rank (0 worst) and condition over the columns of an image's measurements; the first that holds counts. Shares of
#: ink are in units of the image type's limit. A null correlation decides nothing; without measurements all is unknown.
LADDER: tuple[tuple[str, int, str], ...] = (
    ("critical", 0, "dup"),
    ("critical", 1, "mismatch"),
    ("critical", 2, "unmatched"),
    ("unknown", 5, "not measured"),
    ("major", 3, "iou < 0.35 or missing_share > 3 or extra_share > 3 or cc < 0.40"),
    ("major", 4, "iou < 0.60 or missing_share > 1 or extra_share > 1"),
    ("moderate", 6, "iou < 0.80"),
    ("minor", 7, "missing_share > 0.5 or extra_share > 0.5"),
    ("ok", 9, "true"),
)


def severity(measured: DataFrame, id_col: str) -> DataFrame:
    """id, severity and rank by the ladder.

    measured: dup, mismatch, unmatched (booleans), ok (whether there are measurements), iou, missing, extra, cc, img_type.
    """
    filled = measured.select(
        id_col, *[_true(F.col(c)).alias(c) for c in ("dup", "mismatch", "unmatched")], _true(F.col("ok")).alias("measured"), F.coalesce("iou", F.lit(1.0)).alias("iou"), "cc",
        *[(F.coalesce(c, F.lit(0.0)) / ink_limit(F.col("img_type"), extra)).alias(f"{c}_share") for c, extra in (("missing", False), ("extra", True))],
    )
    label, rank = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, place, condition in reversed(LADDER):
        holds = _true(F.expr(condition))
        label, rank = F.when(holds, name).otherwise(label), F.when(holds, place).otherwise(rank)
    return filled.select(id_col, label.alias("severity"), rank.cast("long").alias("rank"))


def flags(measured: DataFrame, id_col: str) -> DataFrame:
    """id and all flags of an image, joined by commas.

    measured: as for severity, and decoded, blobs (solid ones only in the crop), vanished_area, stretchy_page, stretchy_crop,
    page_share, label_conflict, declared_sqdiff.
    """
    c = F.col
    located = c("decoded") & ~c("unmatched")
    ink = located & c("ok")
    drawn = ink & (c("img_type") == "lineart")
    named = (
        ("UNDECODABLE", ~c("decoded")),
        ("DUPLICATE_BYTES", c("decoded") & c("dup")),
        ("UNMATCHED", c("decoded") & c("unmatched")),
        ("LOW_CORRELATION", located & (c("cc") < LOW_CORRELATION)),
        ("INK_MISSING", ink & (c("missing") > ink_limit(c("img_type"), False))),
        ("INK_EXTRA", ink & (c("extra") > ink_limit(c("img_type"), True))),
        ("SOLID_BLOB", drawn & (c("blobs") > 0)),
        ("GLYPH_VANISHED", drawn & (c("vanished_area") > VANISHED_AREA)),
        ("STRETCHY_GLYPH_LOSS", drawn & (c("stretchy_page") > c("stretchy_crop")) & (c("missing") > STRETCHY_MISSING)),
        ("PAGE_REGION", located & (c("page_share") > PAGE_SHARE)),
        ("SLOT_MISMATCH", located & c("mismatch")),
        ("LABEL_CONFLICT", located & c("label_conflict")),
        ("NOT_AT_DECLARED_SLOT", located & (c("declared_sqdiff") > DECLARED_OK) & ~c("mismatch")),
    )
    return measured.select(id_col, F.array_join(F.array_compact(F.array(*[F.when(_true(hit), F.lit(name)) for name, hit in named])), ",").alias("flags"))


def ghost_class(med: Column, iou: Column, ink: Column, unexplained: Column, vanished: Column, ratio: Column) -> Column:
    unsure = (med > 2) | (iou < 0.30) | (ink < 200)
    ghost = (unexplained >= 0.02) & (vanished <= unexplained / 3) & ratio.between(1.03, 1.8)
    return F.when(F.coalesce(unsure, F.lit(True)), "unverified").when(ghost, "ghost").otherwise("clean")
