"""Writers and the text transformations that precede them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_report(findings: DataFrame, path: str, by: str | None = None, fmt: str = "json") -> None:
    """Findings as one dataset, partitioned on wish; Spark's job commit makes it atomic."""
    writer = findings.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).format(fmt).save(path)


def write_tables(tables: dict[str, DataFrame], path: str, by: str = "doc_id", fmt: str = "parquet") -> None:
    """Several tables of an extraction (text, pages, images, ...) side by side, each partitioned by document."""
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy(by).format(fmt).save(f"{path}/{name}")


def write_control_file(path: str, data: bytes) -> None:
    """One small local file, by a temporary one and a rename."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def insert_before(html: Column | str, tag: str, text: str, marker: str) -> Column:
    """html with text before the first tag, unless it holds the marker already or lacks the tag."""
    html = F.col(html) if isinstance(html, str) else html
    at = F.instr(html, tag)
    patched = F.concat(F.substring(html, F.lit(1), at - 1), F.lit(text), F.substring(html, at, F.length(html)))
    return F.when((at > 0) & ~F.contains(html, F.lit(marker)), patched).otherwise(html)


OVERLAP_CSS = "/* plumbline:tags */ .katex-display { position: relative; padding-right: 3.5em; } .katex-display .tag { right: 0; }\n"
WIDE_JS = """<script>/* plumbline:wide */ document.querySelectorAll('.katex-display').forEach(function (box) {
  for (var turn = 0, size = 1; turn < 6 && box.scrollWidth > box.clientWidth; turn++) { size *= 0.93; box.style.fontSize = size + 'em'; }
});</script>
"""


def patch_overlap(df: DataFrame, html_col: str) -> DataFrame:
    out = insert_before(html_col, "</style>", OVERLAP_CSS, "plumbline:tags")
    return df.withColumn("changed", out != F.col(html_col)).withColumn(html_col, out)


def patch_wide(df: DataFrame, html_col: str) -> DataFrame:
    out = insert_before(html_col, "</body>", WIDE_JS, "plumbline:wide")
    return df.withColumn("changed", out != F.col(html_col)).withColumn(html_col, out)


_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
_REF = r"!\[[^\]]*\]\([^)]+\)"


def self_contained(df: DataFrame, assets: DataFrame, id_col: str, md_col: str) -> DataFrame:
    """Markdown with its local images as data URIs, and missing (references without a file, comma-joined).

    assets: id_col, name (as referenced), content. http, data and missing references stay as they are.
    """
    # Text between references and the references alternate; both arrays are rebuilt in order.
    parts = F.split(md_col, _REF, -1)
    refs = F.regexp_extract_all(md_col, F.lit(_REF), F.lit(0))
    rows = df.select(id_col, F.posexplode(refs).alias("k", "ref"))
    rows = rows.withColumn("name", F.regexp_extract("ref", r"\(([^)\s]+)[^)]*\)$", 1))
    suffix = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.lit("image/png")
    for ext, kind in _MIME.items():
        mime = F.when(suffix == ext, kind).otherwise(mime)
    remote = F.regexp_like("name", F.lit("^(?:https?:|data:)"))
    joined = rows.join(assets.select(id_col, "name", "content"), [id_col, "name"], "left")
    uri = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content"))
    new = F.when(F.col("content").isNotNull() & ~remote, F.replace(F.col("ref"), F.concat(F.lit("("), F.col("name")), F.concat(F.lit("("), uri))).otherwise(F.col("ref"))
    lost = F.when(F.col("content").isNull() & ~remote, F.col("name"))
    done = joined.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", new.alias("r")))), lambda x: x["r"]).alias("new_refs"), F.array_join(F.array_sort(F.collect_set(lost)), ",").alias("missing"))
    out = df.join(done, id_col, "left").withColumn("new_refs", F.coalesce("new_refs", F.array().cast("array<string>")))
    text = F.array_join(F.transform(parts, lambda p, k: F.concat(p, F.coalesce(F.get("new_refs", k), F.lit("")))), "")
    return out.withColumn(md_col, text).withColumn("missing", F.coalesce("missing", F.lit(""))).drop("new_refs")


_PAGE = ("<!doctype html><html><head><meta charset='utf-8'><title>", "</title><style></style></head><body>", "</body></html>")


def page(title: Column, body: Column) -> Column:
    """A page around an already rendered body; the title is escaped."""
    safe = F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit(_PAGE[0]), safe, F.lit(_PAGE[1]), body, F.lit(_PAGE[2]))


def overwrite_plan(html: DataFrame, targets: DataFrame) -> DataFrame:
    """src, dst and action for attachments: every HTML file of the target is overwritten, else the page is copied in. Nothing runs.

    html: key, path; targets: key, dir, name (null for an empty folder). Keys are eight letters or digits.
    """
    keyed = html.filter(F.regexp_like("key", F.lit("^[A-Za-z0-9]{8}$"))).withColumn("key", F.upper("key"))
    j = keyed.join(targets.withColumn("key", F.upper("key")), "key")
    is_page = F.coalesce(F.endswith(F.lower("name"), F.lit(".html")), F.lit(False))
    has = j.groupBy("key").agg(F.max(is_page.cast("int")).alias("has"))
    out = j.join(has, "key")
    over = out.filter(is_page).select("key", F.col("path").alias("src"), F.concat_ws("/", "dir", "name").alias("dst"), F.lit("overwrite").alias("action"))
    fresh = out.filter("has = 0").select("key", F.col("path").alias("src"), F.concat_ws("/", "dir", F.regexp_extract("path", r"[^/]+$", 0)).alias("dst"), F.lit("copy").alias("action")).distinct()
    return over.unionByName(fresh)


def export_tables(states: DataFrame, translations: DataFrame) -> DataFrame:
    """The protected Markdown of every finished document: its unit texts in order, a blank line between."""
    done = states.filter("phase = 'text_reviewed'").select("doc_id")
    t = translations.join(done, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("u"))
    return t.select("doc_id", F.concat(F.array_join(F.transform("u", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown"))
