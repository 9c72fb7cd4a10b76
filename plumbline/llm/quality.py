"""Quality rules by repetition coverage.

Each document's words become integer ids, and rolling hashes over them (numpy, modulo 2**64) find the
n-grams of several lengths that occur again. Equal hashes are compared id by id, so a collision cannot
count. Coverage is in characters: those inside an n-gram, or a line, that the document already had.

Cases: a null or empty text has no words, so it fails the base rules and is not kept; repeated rows are judged
one by one and agree; ids may be of any type and null; a very long text is measured whole, in one task; an empty table gives an
empty table; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, col, covered, map_rows, mix, prefix_hash, window_hash


@dataclass(frozen=True)
class QualityRules:
    """Shares of a document's word characters above which it goes, by n-gram length and for lines."""

    ngram_limits: dict[int, float] = field(default_factory=lambda: {5: 0.20, 7: 0.16, 10: 0.12})
    line_share: float = 0.30
    line_chars: float = 0.25
    symbols_per_word: float = 0.5
    min_words: int = 20
    window: int = 8
    window_percent: int = 30


def repeats(ids: np.ndarray, prefix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all n-grams that occur twice or more, and of those that occurred before."""
    none = np.zeros(0, np.int64)
    h = window_hash(prefix, n)
    if len(h) < 2:
        return none, none
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return none, none
    a, b = order[:-1][same], order[1:][same]
    if not all(np.array_equal(ids[a + k], ids[b + k]) for k in range(n)):  # a collision: compare whole windows
        grams = np.lib.stride_tricks.sliding_window_view(ids, n)
        _, first, label, count = np.unique(grams, axis=0, return_index=True, return_inverse=True, return_counts=True)
        at = np.arange(len(grams))
        label = label.reshape(-1)
        return at[count[label] > 1], at[first[label] < at]
    return np.union1d(a, b), b


def measure(text: bytes | None, rules: QualityRules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars and the repeated characters by length."""
    text = text or b""
    words = text.split()
    seen: dict[bytes, int] = {}
    n = len(words)
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if text.isascii():
        chars = np.fromiter(map(len, words), np.int64, n)
    else:
        chars = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, n)
    n_symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines: set[bytes] = set()
    n_lines = dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        body = line.split()
        if body:
            n_lines += 1
            if line in lines:
                dup_lines += 1
                dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in body)
            lines.add(line)
    prefix = prefix_hash(mix(ids + 1))
    twice, _ = repeats(ids, prefix, rules.window)
    n_repeat = int(covered(twice, rules.window, n).sum()) if len(twice) else 0
    dup_chars = []
    for k in rules.ngram_limits:
        _, later = repeats(ids, prefix, k)
        dup_chars.append(int(chars[covered(later, k, n)].sum()) if len(later) else 0)
    return n, int(chars.sum()), n_symbols, dup_lines, n_repeat, n_lines, dup_line_chars, dup_chars


def quality(df: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the counts, base_failed, kept and the repeated characters that led to the verdict."""
    sizes = list(rules.ngram_limits)
    id_type = df.schema[id_col].dataType.simpleString()
    names = [f"dup_chars_{k}" for k in sizes]
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *names]
    schema = f"id {id_type}, " + ", ".join(f"{c} long" for c in longs)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t, rules) for t in binary(batch, "text")]
        flat = [(*r[:7], *r[7]) for r in rows]
        cols = list(zip(*flat)) if flat else [()] * len(longs)
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols)], ["id", *longs])

    m = map_rows(df.select(col(id_col).alias("id"), col(text_col).alias("text")), fn, schema)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.window_percent * F.col("n_words"))
    bad = (F.col("n_dup_lines") > rules.line_share * F.col("n_lines")) | (F.col("dup_line_chars") > rules.line_chars * F.col("word_chars"))
    bad |= F.col("n_symbols") > rules.symbols_per_word * F.col("n_words")
    for k, c in zip(sizes, names):
        bad |= F.col(c) > rules.ngram_limits[k] * F.col("word_chars")
    return m.select(F.col("id").alias(id_col), *longs, failed.alias("base_failed"), (~failed & ~bad).alias("kept"))
