"""Declared schemas of the engine's entities. Order is data, so child tables carry ord."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values, in the order in which they are defined.
KINDS = ("heading", "prose", "caption", "table", "algorithm", "theorem", "reference")
BASE_CHECKS = ("coverage", "logic", "claim_strength", "terminology", "numbers_units", "readability")
KIND_CHECKS = {
    "caption": "panel_mapping",
    "table": "cells_footnotes",
    "algorithm": "variables_control_flow",
    "theorem": "conditions_quantifiers",
    "reference": "bibliographic_identity",
}
UNIT_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
PROFILE_KEYS = ("model", "target_language", "prompt_version", "glossary_sha256", "extractor_version", "formula_mode")


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _split(text: str) -> list[str]:
    """At commas outside angle brackets."""
    out, depth, last = [], 0, 0
    for k, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(text[last:k])
            last = k + 1
    return [*out, text[last:]]


def _type(text: str) -> T.DataType:
    text = text.strip()
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n.strip(), _type(t)) for n, _, t in (f.partition(":") for f in _split(text[7:-1]))])
    return _SIMPLE[text]


def _t(ddl: str) -> T.StructType:
    """A schema without a running session."""
    return T.StructType([T.StructField(n, _type(t)) for n, _, t in (f.strip().partition(" ") for f in _split(ddl))])


UNIT = _t("id string, kind string, page int, source string, source_flags array<string>")
FACT = _t("evidence_ids array<string>, evidence_quotes array<struct<quote: string, unit_id: string>>, text string")
TERM = _t("definition string, domain string, example string, id string, sense string, source string, status string, target string, unit_ids array<string>, variants array<string>")
DOCUMENT = T.StructType([T.StructField("context", T.ArrayType(FACT)), T.StructField("glossary", T.ArrayType(TERM)), T.StructField("schema_version", T.IntegerType()), T.StructField("units", T.ArrayType(UNIT))])
TRANSLATION = _t("units array<struct<id: string, text: string>>")
FINDING_DETAIL = _t("issue string, source_quote string, suggestion string, translation_quote string")
REVIEW_UNIT = _t("checks array<string>, findings array<struct<issue: string, source_quote: string, suggestion: string, translation_quote: string>>, id string, needs_polish boolean, verdict string")
REVIEW = T.StructType([T.StructField("decisions", T.MapType(T.StringType(), T.StringType())), T.StructField("document_sha256", T.StringType()), T.StructField("reviewer", T.StringType()), T.StructField("translation_sha256", T.StringType()), T.StructField("units", T.ArrayType(REVIEW_UNIT))])
FINDINGS = _t("subject_id string, rule string, severity string, ord long, match string, detail string")
ISSUE = _t("doc_id string, id string, unit_id string, code string, severity string, detail string")
CACHE_BLOCK = _t("block_id string, source_sha256 string, translation string, translation_sha256 string, status string, issues array<string>")
CAPTION = _t("page int, num int, col string, x0 double, y0 double, x1 double, y1 double, text string")
REGION = _t("kind string, num int, page int, x0 double, y0 double, x1 double, y1 double, caption string")
SOURCE_MAP = _t("id string, kind string, page int, bbox array<double>, label string, fragment string, target_block string, review_status string")
QA_ITEM = _t("name string, status string, evidence string")
WARNING = _t("code string, severity string, stage string, block_id string, page int, message string, resolved boolean")
