"""Embedded images against the pages that they were cut from. A document's pages meet its images in one task.

Tables: images(doc_id, idx, content, declared_kind, declared_num, label_conflict), pages(doc_id, page, content) with PNGs of whole pages
at `dpi`, and places(doc_id, kind, num, page, x0, y0, x1, y1) in points.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rasters
from . import regions

_FOUND = "idx long, decoded boolean, tier long, hit_kind string, hit_num long, page long, sqdiff double, ccoeff double, ambiguous boolean, declared_sqdiff double, page_share double, error string"
_INK = "ok boolean, img_type string, ink_crop long, ink_page long, missing double, extra double, iou double, ratio double, blobs long, vanished_area long, stretchy_page long, stretchy_crop long, hash_distance long"
_GHOST = "idx long, class string, page long, scale double, unexplained double, vanished double, ratio double, iou double, ink long, med double, mad double"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _sheets(pages: pd.DataFrame, dpi: int) -> rasters.Sheets:
    decoded = {int(n): rasters.decode_png(bytes(c)) for n, c in zip(pages["page"], pages["content"]) if c is not None}
    return rasters.Sheets({n: g for n, g in decoded.items() if g is not None}, dpi)


def _beside(images: DataFrame, pages: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], list[tuple]], ddl: str) -> DataFrame:
    """fn(images, pages) by document; documents without images give nothing."""
    kind = images.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", *_names(ddl)]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = [(left["doc_id"].iloc[0], *row) for row in fn(left.sort_values("idx"), right)] if len(left) else []
        return pd.DataFrame(rows, columns=columns, dtype=object)

    sheets = pages.select(F.col("doc_id").alias("of_doc"), *[c for c in pages.columns if c != "doc_id"])  # both may stem from one table
    # Little data but much work for each document: as many tasks as the session's shuffles have, which adaptive execution keeps.
    tasks = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = images.repartition(tasks, "doc_id"), sheets.repartition(tasks, "of_doc")
    return left.groupBy("doc_id").cogroup(right.groupBy("of_doc")).applyInPandas(run, f"doc_id {kind}, {ddl}")


def locate(images: DataFrame, pages: DataFrame, places: DataFrame, dpi: int = rasters.FINE_DPI, ladder: list[float] | None = None) -> DataFrame:
    """Where each image comes from, and how its ink differs from the page's there."""
    by_page = places.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("kind", "num", "x0", "y0", "x1", "y1"))).alias("places"))
    ink = _names(_INK)

    def fn(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        sheets = _sheets(right, dpi)
        held = [rasters.Region(r["kind"], int(r["num"]), int(n), (r["x0"], r["y0"], r["x1"], r["y1"])) for n, rs in zip(right["page"], right["places"]) if rs is not None for r in rs if int(n) in sheets.pages]

        def one(r: dict) -> tuple:
            crop = rasters.decode_png(bytes(r["content"])) if r["content"] is not None else None
            if crop is None:
                return (r["idx"], False, 0, *[None] * 5, False, None, None, None, False, *[None] * (len(ink) - 1))
            num = None if pd.isna(r["declared_num"]) else int(r["declared_num"])
            at = rasters.locate(crop, sheets, held, (r["declared_kind"], num), ladder)
            m = rasters.pair_metrics(crop, at["raster"])
            share = None
            if at["box_pt"]:
                page, (x0, y0, x1, y1) = sheets.page(at["page"], rasters.FINE_DPI), at["box_pt"]
                share = round((x1 - x0) * (y1 - y0) / (page.size * (rasters.POINTS / rasters.FINE_DPI) ** 2), 4)
            return (r["idx"], True, at["tier"], at["kind"], at["num"], at["page"], at["sqdiff"], at["ccoeff"], at["ambiguous"], at["declared_sqdiff"], share, None, *(m.get(c) for c in ink))

        out = []
        for r in left.to_dict("records"):
            try:
                out.append(one(r))
            except Exception as e:  # noqa: BLE001  one image's failure is a row, not the job's
                out.append((r["idx"], True, 0, *[None] * 5, False, None, None, f"{type(e).__name__}: {e}"[:200], False, *[None] * (len(ink) - 1)))
        return out

    return _beside(images.drop("label_conflict"), pages.join(by_page, ["doc_id", "page"], "left"), fn, f"{_FOUND}, {_INK}")


def judge(images: DataFrame, located: DataFrame) -> DataFrame:
    """severity, rank and flags of every image: doc_id, idx, severity, rank, flags."""
    said = images.select("doc_id", "idx", "declared_kind", "declared_num", "label_conflict", F.sha2("content", 256).alias("sha"))
    w = Window.partitionBy("doc_id", "sha")
    said = said.withColumn("dup", F.col("sha").isNotNull() & (F.count(F.lit(1)).over(w) > 1)).withColumnsRenamed({"doc_id": "of", "idx": "at"})
    j = located.join(said, (F.col("doc_id") == F.col("of")) & (F.col("idx") == F.col("at"))).drop("of", "at")
    mismatch = regions.slot_mismatch(*map(F.col, ("declared_kind", "declared_num", "hit_kind", "hit_num", "ambiguous")))
    m = j.withColumn("key", F.struct("doc_id", "idx")).withColumn("mismatch", mismatch)
    m = m.withColumn("unmatched", F.col("decoded") & F.col("page").isNull()).withColumnRenamed("ccoeff", "cc")
    told = regions.flags(m, "key").withColumnRenamed("key", "flag_key")
    both = regions.severity(m, "key").join(told, F.col("key") == F.col("flag_key"))
    undecoded = F.col("flags") == "UNDECODABLE"
    # An image that could not be judged is unknown, with that flag alone.
    failed = m.filter("error is not null").select(F.col("key").alias("failed"))
    both = both.join(failed, F.col("key") == F.col("failed"), "left").withColumn("flags", F.when(F.col("failed").isNotNull(), "ERROR").otherwise(F.col("flags")))
    both = both.withColumn("severity", F.when(F.col("failed").isNotNull(), "unknown").otherwise(F.col("severity"))).withColumn("rank", F.when(F.col("failed").isNotNull(), 5).otherwise(F.col("rank")))
    return both.select("key.doc_id", "key.idx", F.when(undecoded, "critical").otherwise(F.col("severity")).alias("severity"), F.when(undecoded, 2).otherwise(F.col("rank")).cast("long").alias("rank"), "flags")


def evidence(images: DataFrame, pages: DataFrame, located: DataFrame, dpi: int = rasters.FINE_DPI) -> DataFrame:
    """doc_id, idx and a PNG with the crop, its page region and the differing ink, of every located image."""
    kept = images.join(located.filter("page is not null").select("doc_id", "idx", F.col("page").alias("hit_page"), "hit_kind", "hit_num"), ["doc_id", "idx"])

    def fn(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        sheets, out = _sheets(right, dpi), []
        for r in left.to_dict("records"):
            crop, n = rasters.decode_png(bytes(r["content"])), int(r["hit_page"])
            if crop is not None and n in sheets.pages:
                page = sheets.page(n, rasters.COARSE_DPI)
                p = rasters.best_placement(crop, page, rasters.scale_ladder())
                if p:
                    out.append((r["idx"], rasters.encode_png(rasters.evidence(crop, page[p.y : p.y + p.h, p.x : p.x + p.w]))))
        return out

    return _beside(kept.select("doc_id", "idx", "content", "hit_page"), pages, fn, "idx long, png binary")


def ghosts(images: DataFrame, pages: DataFrame, dpi: int = rasters.FINE_DPI) -> DataFrame:
    """class and metrics of every image by the ghost audit."""
    columns = _names(_GHOST)[1:]

    def fn(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        sheets = _sheets(right, dpi)
        found = [(r["idx"], rasters.ghost_audit(rasters.decode_png(bytes(r["content"])) if r["content"] is not None else None, sheets)) for r in left.to_dict("records")]
        return [(idx, *(m.get(c) for c in columns)) for idx, m in found]

    return _beside(images.select("doc_id", "idx", "content"), pages, fn, _GHOST)


def measure(pixels: DataFrame) -> DataFrame:
    """Kind, threshold, ink and components of rasters a, and how the ink of b differs: one row a doc_id.

    pixels: doc_id, w, a and b (arrays of grey levels, row by row).
    """
    ddl = "img_type string, threshold long, ink long, n_components long, n_blobs long, n_tall long, missing long, extra long, common long"
    kind = pixels.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for i, w, a, b in zip(pdf["doc_id"], pdf["w"], pdf["a"], pdf["b"]):
                a, b = (np.asarray(x, np.uint8).reshape(-1, int(w)) for x in (a, b))
                x, y = rasters.ink(a), rasters.ink(b)
                counts = [len(f(x)) for f in (rasters.components, rasters.solid_blobs, rasters.tall_glyphs)]
                rows.append((i, rasters.image_type(a), rasters.otsu(a), int(x.sum()), *counts, int((y & ~rasters.dilate(x)).sum()), int((x & ~rasters.dilate(y)).sum()), int((x & y).sum())))
            yield pd.DataFrame(rows, columns=["doc_id", *_names(ddl)], dtype=object)

    return pixels.mapInPandas(run, f"doc_id {kind}, {ddl}")
