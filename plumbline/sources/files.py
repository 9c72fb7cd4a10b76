"""Readers: whole text files, JSON documents, asset folders, hashes and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def _binary(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_texts(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """path and text of every file; malformed UTF-8 is replaced, never an error."""
    files = _binary(spark, path, pattern)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_html(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_texts(spark, path, "*.[hH][tT][mM][lL]")


def read_markdown(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_texts(spark, path, "*.[mM][dD]")


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.DOCUMENT) -> DataFrame:
    """path, doc (null if it does not parse) of one JSON object a file; a byte order mark is dropped."""
    text = read_texts(spark, path, "*.json").withColumn("text", F.regexp_replace("text", r"^\x{FEFF}", ""))
    return text.select("path", F.from_json("text", schema).alias("doc"))


def document_tables(docs: DataFrame, id_col: str = "path", doc_col: str = "doc") -> dict[str, DataFrame]:
    """units, facts and terms of nested documents, each with doc_id and ord (from 1)."""
    out = {}
    for name, field in (("units", "units"), ("facts", "context"), ("terms", "glossary")):
        rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(f"{doc_col}.{field}").alias("ord", "x"))
        out[name] = rows.select("doc_id", (F.col("ord") + 1).cast("long").alias("ord"), "x.*")
    return out


def translation_table(translations: DataFrame, id_col: str = "path", col: str = "doc") -> DataFrame:
    rows = translations.select(F.col(id_col).alias("doc_id"), F.posexplode(f"{col}.units").alias("ord", "x"))
    return rows.select("doc_id", (F.col("ord") + 1).cast("long").alias("ord"), "x.*")


def list_assets(spark: SparkSession, path: str) -> DataFrame:
    """Distinct file names of a folder; file contents are not read."""
    return _binary(spark, path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("name")).distinct()


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _binary(spark, path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("nbytes"))


def registry(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Entries of a JSON map key -> {status, inv.decodable, html_snap, pdf_snap} that can be audited, the largest first."""
    entry = T.StructType([T.StructField("status", T.StringType()), T.StructField("inv", T.StructType([T.StructField("decodable", T.LongType())])), T.StructField("html_snap", T.StringType()), T.StructField("pdf_snap", T.StringType())])
    text = read_texts(spark, path, "*.json")
    out = text.select(F.explode(F.from_json("text", T.MapType(T.StringType(), entry))).alias("key", "e"))
    out = out.select("key", "e.status", F.col("e.inv.decodable").alias("decodable"), "e.html_snap", "e.pdf_snap").filter("status = 'OK' and decodable > 0")
    return (out.filter(F.col("key").isin(only)) if only else out).orderBy(F.desc("decodable"), "key")


CAPTION_LINE = r"^Fig(?:ure)?\.?\s*([0-9]+)\s*[.:]"


def captions(blocks: DataFrame, col_x: float = 300.0, max_lines: int = 6) -> DataFrame:
    """Caption blocks of PDF text blocks (doc_id, page, x0, y0, x1, y1, text), with number and column; in no order."""
    first = F.split("text", "\n")[0]
    hit = blocks.filter(F.regexp_like(first, F.lit(CAPTION_LINE)) & (F.size(F.split(F.rtrim("text"), "\n")) <= max_lines))
    out = hit.withColumn("num", F.regexp_extract(first, CAPTION_LINE, 1).cast("int")).withColumn("col", F.when(F.col("x0") < col_x, "L").otherwise("R"))
    return out


def anchors(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Equation numbers right of 42 percent of the page's width, and table or figure captions (a table first)."""
    number = r"^\(([0-9]{1,3})\)$"
    eq = words.filter(F.regexp_like("text", F.lit(number)) & (F.col("x0") > 0.42 * F.col("width"))).select("doc_id", "page", F.lit("eq").alias("kind"), F.regexp_extract("text", number, 1).cast("int").alias("num"), "x0", "y0", "x1", "y1")
    tab, fig = r"(?i)^\s*Table\s*([0-9]+)\b", r"(?i)^\s*Fig(?:ure)?\.?\s*([0-9]+)\b"
    kind = F.when(F.regexp_like("text", F.lit(tab)), "tab").when(F.regexp_like("text", F.lit(fig)), "fig")
    num = F.when(F.col("kind") == "tab", F.regexp_extract("text", tab, 1)).otherwise(F.regexp_extract("text", fig, 1)).cast("int")
    caps = blocks.withColumn("kind", kind).filter("kind is not null").withColumn("num", num)
    return eq.unionByName(caps.select("doc_id", "page", "kind", "num", "x0", "y0", "x1", "y1"))


def lines_with(lines: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """Text lines that hold any of the words, whatever the case; places (x0, y0, x1, y1, where there are) to a tenth. In no order."""
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text_col), F.lower(w)))
    return lines.filter(hit).withColumns({c: F.bround(c, 1) for c in ("x0", "y0", "x1", "y1") if c in lines.columns})


def read_order(lines: DataFrame, keys: list[str], bucket: float = 20.0) -> DataFrame:
    """Recognised lines (keys, x, y, text, score) of an image as one text: by bands of height, then from the left."""
    held = F.array_sort(F.collect_list(F.struct(F.bround(F.col("y") / bucket).alias("band"), "x", "text", "score")))
    said = F.transform(held, lambda r: F.concat(r["text"], F.lit(" ("), F.format_number(r["score"], 2), F.lit(")")))
    return lines.groupBy(*keys).agg(F.array_join(said, " | ").alias("text"))


def total_bytes(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of all files of a folder; contents are not read."""
    return _binary(spark, path).agg(F.sum("length")).first()[0] or 0


def probe_stats(df: DataFrame, col: str) -> DataFrame:
    """A 'k:v ## k:v' probe string as a map; only the first colon of a part separates."""
    parts = F.transform(F.split(col, " ## "), lambda p: F.struct(F.regexp_extract(p, "^([^:]*):", 1).alias("k"), F.regexp_extract(p, "^[^:]*:([\\s\\S]*)$", 1).alias("v")))
    return df.withColumn("stats", F.map_from_entries(parts))


def judge(stats: DataFrame, id_col: str) -> DataFrame:
    """Problems of a probed page: overlaps, broken or not embedded images, leftover dollars (columns of counts)."""
    names = ("overlaps", "broken", "nonEmbedded", "leftoverDollar")
    bad = F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit(0)) != 0, F.lit(n)) for n in names]))
    return stats.select(id_col, F.array_join(bad, ",").alias("problems"), (F.size(bad) == 0).alias("ok"))
