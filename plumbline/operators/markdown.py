"""Structure checks on Markdown: one row a document, no shuffle unless two tables must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of, lines, matches, strip

_SKIPPED = ("$$", "![", "#", "|", "`", "http", "- [", "[", ">")
_MARKERS = ("English original", "**English**")
_EAST_ASIAN = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"


def residue_lines(text: Column | str, min_letters: int = 60) -> Column:
    """(line, text) of the lines that look like untranslated prose; lines count from 1."""
    # By rising cost: a line of no more characters than that is passed over before any regular expression runs.
    numbered = F.transform(lines(text), lambda line, k: F.struct((k + 1).cast("long").alias("line"), line.alias("text")))
    long = F.filter(numbered, lambda x: F.length(x["text"]) > min_letters)
    stripped = F.transform(long, lambda x: F.struct(x["line"].alias("line"), strip(x["text"]).alias("text")))

    def suspicious(x: Column) -> Column:
        s = x["text"]
        skip = F.contains(s, F.lit("\\"))
        for p in _SKIPPED:
            skip = skip | F.startswith(s, F.lit(p))
        return ~skip & (F.regexp_count(s, F.lit("[A-Za-z]")) > min_letters) & ~F.regexp_like(s, F.lit(_EAST_ASIAN))

    return F.filter(stripped, suspicious)


def english_residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """n_hits, first_line and n_markers of the documents with residue."""
    marker = sum((F.contains(F.col(text_col), F.lit(m)).cast("long") for m in _MARKERS), F.lit(0))
    found = df.select(id_col, residue_lines(text_col).alias("hit"), marker.cast("long").alias("n_markers"))
    out = found.select(id_col, F.size("hit").cast("long").alias("n_hits"), F.try_element_at("hit", F.lit(1))["line"].alias("first_line"), "n_markers")
    return out.filter("n_hits > 0 or n_markers > 0")


def delimiter_parity(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts behind the pairing checks of display lines, inline dollars and bracket delimiters."""
    display = F.size(F.filter(lines(text_col), lambda x: strip(x) == "$$")).cast("long")
    inline = count_of(F.replace(F.col(text_col), F.lit("$$"), F.lit("")), "$")
    left_over = count_of(text_col, "\\(") + count_of(text_col, "\\)")
    return df.select(id_col, display.alias("display_lines"), inline.alias("inline_dollars"), left_over.alias("bracket_delims"))


def equation_numbers(df: DataFrame, id_col: str, text_col: str, max_eq: int, allow_dup: list[str] | None = None) -> DataFrame:
    """missing, extra and too frequent equation numbers (comma-joined)."""
    tags = matches(text_col, r"\\tag\{([^}]+)\}", 1)
    plain = F.filter(tags, lambda t: F.regexp_like(t, F.lit("^[0-9]+$")))
    inner = matches(text_col, r"\\text\{\(([0-9]+)[a-z]?\)\}", 1)
    nums = F.array_sort(F.array_distinct(F.transform(F.concat(plain, inner), lambda x: x.cast("long"))))
    wanted = F.sequence(F.lit(1).cast("long"), F.lit(max_eq).cast("long"))
    often = F.filter(F.array_distinct(plain), lambda t: (F.size(F.filter(plain, lambda u: u == t)) > 2) & ~t.isin(list(allow_dup or [""])))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return df.select(id_col, joined(F.array_except(wanted, nums)).alias("missing"), joined(F.array_except(nums, wanted)).alias("extra"), F.array_join(F.array_sort(often), ",").alias("repeated"))


def formula_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a $$ block, in order from 0."""
    return df.select(id_col, F.posexplode(matches(text_col, r"(?s)\$\$(.+?)\$\$", 1)).alias("block", "tex")).withColumn("block", F.col("block").cast("long"))


def bracket_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks whose \\left and \\right counts differ, or with an environment that is not closed as often as opened."""
    b = formula_blocks(df, id_col, text_col)
    left = count_of("tex", "\\left") - count_of("tex", "\\leftarrow")
    right = count_of("tex", "\\right") - count_of("tex", "\\rightarrow")
    envs = matches("tex", r"\\begin\{([\p{L}\p{N}_]+)\}", 1)
    count = lambda word, e: F.length("tex") - F.length(F.replace(F.col("tex"), F.concat(F.lit(f"\\{word}{{"), e, F.lit("}")), F.lit("")))
    # \begin{e} is two characters longer than \end{e}, so lengths are scaled to counts.
    uneven = F.filter(envs, lambda e: count("begin", e) / (F.length(e) + 8) != count("end", e) / (F.length(e) + 6))
    out = b.select(id_col, "block", left.alias("n_left"), right.alias("n_right"), F.size(uneven).cast("long").alias("open_envs"))
    return out.filter("n_left <> n_right or open_envs > 0")


def scope_ambiguity(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hints: two adjacent groups of which the second holds a minus and neither fraction nor environment."""
    b = formula_blocks(df, id_col, text_col)
    second = F.concat(matches("tex", r"(?s)\\left\((.{1,80}?)\\right\)\s*\\left\((.{1,140}?)\\right\)", 2), matches("tex", r"(?s)(?<!\\left)\(([^()]{1,80})\)\s*\(([^()]{1,140})\)", 2))
    hit = F.filter(second, lambda g: F.regexp_like(g, F.lit("[-−]")) & ~F.regexp_like(g, F.lit(r"\\frac|\\begin\{")))
    return b.select(id_col, "block", F.size(hit).cast("long").alias("n_hints")).filter("n_hints > 0")


MAX_REQUIRED = 16_000_000  # characters of required texts, which ride along with every document


def missing_texts(df: DataFrame, required: DataFrame, id_col: str, text_col: str, key_col: str, required_col: str) -> DataFrame:
    """n_missing and missing (sorted keys, joined by commas) of each document that lacks a required text; required has key_col and required_col.

    The documents are the large side. The required texts are a caller's list: it is measured first, and more than MAX_REQUIRED
    characters are an error; then it is one array at every document, and nothing is shuffled.
    """
    size = required.agg(F.sum(F.length(required_col))).first()[0] or 0
    if size > MAX_REQUIRED:
        raise ValueError(f"required texts have {size} characters, more than {MAX_REQUIRED}")
    wanted = required.agg(F.array_sort(F.collect_set(F.struct(F.col(key_col).alias("key"), F.col(required_col).alias("text")))).alias("wanted"))
    lacking = F.transform(F.filter("wanted", lambda w: ~F.contains(F.col(text_col), w["text"])), lambda w: w["key"])
    found = df.join(F.broadcast(wanted)).select(id_col, lacking.alias("keys"))
    joined = F.array_join(F.transform("keys", lambda k: k.cast("string")), ",")
    return found.filter(F.size("keys") > 0).select(id_col, F.size("keys").cast("long").alias("n_missing"), joined.alias("missing"))


def image_refs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base names of the PNG files a document shows, in order."""
    refs = df.select(id_col, F.posexplode(matches(text_col, r"!\[[^\]]*\]\(([^)]+\.png)\)", 1)).alias("ord", "ref"))
    return refs.select(id_col, F.col("ord").cast("long").alias("ord"), F.regexp_extract("ref", r"[^/]+$", 0).alias("name"))


def image_count_diff(df: DataFrame, id_col: str, text_col: str, expected: Column) -> DataFrame:
    """n_refs and expected of documents that show another number of PNG files than expected; an expectation of 0 is none."""
    n = F.size(matches(text_col, r"!\[[^\]]*\]\(([^)]+\.png)\)", 1)).cast("long")
    found = df.select(id_col, n.alias("n_refs"), expected.cast("long").alias("expected"))
    return found.filter("expected <> 0 and n_refs <> expected")


def asset_diff(refs: DataFrame, assets: DataFrame, id_col: str) -> DataFrame:
    """Referenced files that are not there, and PNG files that nothing refers to; assets has id_col and name."""
    lost = refs.select(id_col, "name").distinct().join(assets, [id_col, "name"], "left_anti").withColumn("finding", F.lit("missing"))
    idle = assets.filter(F.endswith(F.lower("name"), F.lit(".png"))).distinct().join(refs, [id_col, "name"], "left_anti").withColumn("finding", F.lit("unreferenced"))
    return lost.unionByName(idle)


def formulas(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Display and inline formulas, trimmed."""
    block = F.transform(matches(text_col, r"\$\$([\s\S]+?)\$\$", 1), lambda x: F.struct(F.lit("block").alias("kind"), strip(x).alias("tex")))
    rest = F.regexp_replace(text_col, r"\$\$[\s\S]+?\$\$", "")
    inline = F.transform(matches(rest, r"(?<!\$)\$([^$\n]+?)\$(?!\$)", 1), lambda x: F.struct(F.lit("inline").alias("kind"), strip(x).alias("tex")))
    out = df.select(id_col, F.posexplode(F.concat(block, inline)).alias("ord", "f"))
    return out.select(id_col, F.col("ord").cast("long").alias("ord"), "f.kind", "f.tex")
