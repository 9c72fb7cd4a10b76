"""Column expressions for text checks. Everything stays in the JVM.

Patterns write word characters as [\\p{L}\\p{N}_], which Java, RE2 and Python's regex module read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CLASS = r"[\p{L}\p{N}_]"
TOKEN = r"\[\[(?:EQ|IMG|CITE):[^\]\r\n]+\]\]"
NUMBER = r"(?<![\p{L}\p{N}_.])[+\-−]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[eE][+\-−]?[0-9]+)?(?:(?U:\s)*[%％])?"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def strip(c: Column | str) -> Column:
    """Unicode white space off both ends; Spark's trim knows the space alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def lines(c: Column | str) -> Column:
    return F.split(c, "\n", -1)


def matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def count_of(c: Column | str, literal: str) -> Column:
    """Occurrences of a literal, without a regular expression."""
    c = F.col(c) if isinstance(c, str) else c
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def tokens(c: Column | str) -> Column:
    """Protected placeholders, sorted: equal arrays are equal multisets."""
    return F.array_sort(matches(c, TOKEN))


def numbers(c: Column | str) -> Column:
    """Numbers outside placeholders, normalised and sorted."""
    found = matches(F.regexp_replace(c, TOKEN, ""), NUMBER)
    return F.array_sort(F.transform(found, lambda x: F.translate(F.regexp_replace(x, r"(?U)\s+", ""), "−％,", "-%")))


def term_present(text: Column, term: Column) -> Column:
    r"""Whole-word, case-insensitive presence of a literal term (\E inside it is quoted piecewise)."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(f"(?iu)(?<!{WORD_CLASS})"), quoted, F.lit(f"(?!{WORD_CLASS})"))
    return F.contains(F.lower(text), F.lower(term)) & F.regexp_like(text, pattern)


def fingerprint(c: Column) -> Column:
    """SHA-256 of a struct as compact JSON with its nulls; declare its fields in alphabetical order."""
    return F.sha2(F.to_json(c, {"ignoreNullFields": "false"}), 256)


def balanced(tex: Column | str, opener: str, closer: str) -> Column:
    """Whether a pair of delimiters nests; a backslash hides the next character."""
    tex = F.col(tex) if isinstance(tex, str) else tex
    plain = F.regexp_replace(tex, r"(?s)\\.?", "")
    marks = matches(plain, rf"[\{opener}\{closer}]")
    walk = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")),
        lambda s, m: F.struct((s["depth"] + F.when(m == opener, 1).otherwise(-1)).alias("depth"), (s["ok"] & (s["depth"] + F.when(m == opener, 1).otherwise(-1) >= 0)).alias("ok")),
        lambda s: s["ok"] & (s["depth"] == 0),
    )
    return walk


def plain_text(html: Column | str) -> Column:
    """Tags to blanks, five entities decoded in a fixed order, blanks collapsed and stripped."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def visible_text(html: Column | str) -> Column:
    """Fast visible view: comments, verbatim elements without nested tags, and tags become blanks.

    For nested verbatim markup, offsets or formula subtrees use functions.scanner.
    """
    out = F.regexp_replace(html, r"<!--[\s\S]*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(?:script|style|pre|code|textarea|option|noscript)\b[^>]*>[^<]*</[A-Za-z][^>]*>", " ")
    return F.regexp_replace(out, r"<[A-Za-z/!?][^>]*>", " ")


def be_int(data: Column, at: int) -> Column:
    """Four big-endian bytes from 1-based position at."""
    return F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")


def le_short(data: Column, at: int) -> Column:
    return F.conv(F.concat(F.hex(F.substring(data, at + 1, 1)), F.hex(F.substring(data, at, 1))), 16, 10).cast("long")


def image_header(data: Column) -> Column:
    """kind, w and h of PNG and GIF bytes; '?' with 0 x 0 for anything else (JPEG: functions.scanner.jpeg_dims)."""
    png = F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A"
    gif = F.hex(F.substring(data, 1, 3)) == "474946"
    big = F.octet_length(data) >= 24
    small = F.octet_length(data) >= 10
    return F.struct(
        F.when(png & big, "png").when(gif & small, "gif").otherwise("?").alias("kind"),
        F.when(png & big, be_int(data, 17)).when(gif & small, le_short(data, 7)).otherwise(0).cast("long").alias("w"),
        F.when(png & big, be_int(data, 21)).when(gif & small, le_short(data, 9)).otherwise(0).cast("long").alias("h"),
    )


def data_uri_bytes(src: Column) -> Column:
    """The payload of a data URI, null if it is no base64."""
    payload = F.regexp_replace(F.substring_index(src, ",", -1), r"[^A-Za-z0-9+/]", "")
    return F.when(F.contains(src, F.lit(",")), F.try_to_binary(payload, F.lit("base64")))
