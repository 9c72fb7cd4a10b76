"""Visible-source leaks as native regular-expression rules, all of them in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import matches

#: rule -> (pattern, group, blocking); (?U) makes Java's classes those of Unicode
TEXT_RULES = {
    "latex_in_prose": ("(?U)" + fixed.LATEX_IN_PROSE, 0, True),
    "prose_script": ("(?U)" + fixed.PROSE_SCRIPT, 0, True),
    "md_strike": (fixed.MD_STRIKE, 0, True),
    "md_bold": (fixed.MD_BOLD, 0, True),
    "md_quote": ("(?mU)" + fixed.MD_QUOTE, 0, True),
    "md_italic": ("(?U)" + fixed.MD_ITALIC, 1, True),
    "doubled_backslash": (fixed.DOUBLED_BACKSLASH, 0, True),
    "leaked_paths": ("(?U)" + fixed.LEAKED_PATHS, 0, True),
}
HTML_RULES = {
    "img_stray_gt": (fixed.STRAY_GT, 0, True),
    "katex_errors": (r'<span class="katex-error"', 0, True),
    "external_refs": (r'<(?:script|link)[^>]*?(?:src|href)="((?:http|//)[^"]*)"', 1, True),
    "external_css": (r"""url\(\s*['"]?(?:https?:)?//""", 0, True),
}


def regex_findings(df: DataFrame, id_col: str, text_col: str, rules: dict[str, tuple[str, int, bool]]) -> DataFrame:
    """subject_id, rule, severity, ord, match of every hit, in document order from 0 by rule."""
    hits = [F.struct(F.lit(name).alias("rule"), F.lit("error" if blocking else "info").alias("severity"), matches(text_col, pattern, group).alias("found")) for name, (pattern, group, blocking) in rules.items()]
    each = df.select(F.col(id_col).alias("subject_id"), F.explode(F.array(*hits)).alias("h")).filter("size(h.found) > 0")
    out = each.select("subject_id", "h.rule", "h.severity", F.posexplode("h.found").alias("ord", "match"))
    return out.withColumn("ord", F.col("ord").cast("long"))


def rule_counts(df: DataFrame, id_col: str, text_col: str, rules: dict[str, tuple[str, int, bool]]) -> DataFrame:
    """Hits of each rule by document, without a shuffle; documents without hits are left out."""
    counts = [F.regexp_count(F.col(text_col), F.lit(pattern)).cast("long").alias(name) for name, (pattern, _, _) in rules.items()]
    out = df.select(F.col(id_col), *counts)
    return out.filter(" or ".join(f"{name} > 0" for name in rules))


def judge(df: DataFrame, id_col: str, text_col: str, rules: dict[str, tuple[str, int, bool]]) -> DataFrame:
    """ok, and how many blocking findings, for every document; counted row by row, without a shuffle."""
    counts = [F.coalesce(F.regexp_count(F.col(text_col), F.lit(pattern)), F.lit(0)).cast("long") for pattern, _, blocking in rules.values() if blocking]
    return df.select(id_col, sum(counts[1:], counts[0]).alias("n_blocking")).select(id_col, "n_blocking", (F.col("n_blocking") == 0).alias("ok"))


def without_blocks(html_col: str):
    """HTML without script and style elements."""
    out = F.regexp_replace(html_col, r"(?i)<script\b[^>]*>[\s\S]*?</script\s*>", "")
    return F.regexp_replace(out, r"(?i)<style\b[^>]*>[\s\S]*?</style\s*>", "")


def reference_findings(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """subject_id, rule, severity of each formula that failed to render and each resource outside the page."""
    shown = F.regexp_replace(F.regexp_replace(html_col, r"(?s)<style.*?</style>", ""), r"(?s)<script.*?</script>", "")
    linked = F.filter(matches(html_col, r'<(?:script|link)[^>]*?(?:src|href)="([^"]*)"', 1), lambda x: x.startswith("http") | x.startswith("//"))
    hits = {"katex_errors": matches(shown, HTML_RULES["katex_errors"][0]), "external_refs": F.concat(linked, matches(html_col, HTML_RULES["external_css"][0]))}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), found.alias("found")) for name, found in hits.items()]))
    rows = df.select(F.col(id_col).alias("subject_id"), each.alias("h")).select("subject_id", "h.rule", F.explode("h.found"))
    return rows.select("subject_id", "rule", F.lit("error").alias("severity"))


def verdicts(subjects: DataFrame, findings: DataFrame, id_col: str) -> DataFrame:
    """ok, and how many blocking findings, for every subject."""
    bad = findings.filter("severity = 'error'").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_blocking"))
    joined = subjects.select(id_col).join(bad, F.col(id_col) == F.col("subject_id"), "left")
    n = F.coalesce("n_blocking", F.lit(0)).cast("long")
    return joined.select(id_col, n.alias("n_blocking"), (n == 0).alias("ok"))


def examples(findings: DataFrame, most: int = 6) -> DataFrame:
    """subject_id, rule, shown (the first matches in order, joined by ' | ') and omitted (how many more there are)."""
    w = Window.partitionBy("subject_id", "rule").orderBy("ord")
    first = findings.withColumn("k", F.row_number().over(w)).groupBy("subject_id", "rule")
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "match")))), lambda x: x["match"])
    return first.agg(F.array_join(shown, " | ").alias("shown"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("omitted"))
