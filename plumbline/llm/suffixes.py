"""Suffix dedup: bytes inside a string of a window's length that also starts earlier in the corpus.

A difference-cover method, cut at the window's length. Positions whose place in their document, modulo PERIOD, lies in
a difference cover are sampled; the cover is perfect, so of any two suffixes exactly one shift below PERIOD (all of its size if they are
in step) brings both onto samples. Sampled tuples are named, and names that occur twice are found by ranges. A tuple of
window - PERIOD + 1 bytes fits into any window at every shift, so suffixes with a common window share a sample's name. The
remaining suffixes are merged through these names: each goes to the repeated names within its reach, where suffixes are sorted so that
equal prefixes of a window's length stand side by side, adjacent ones are compared byte by byte, and all but the first are marked.

What is left out of the full algorithm: names are hashes, not ranks, and there is no recursion on them, since prefixes are compared to a
window's length only; the period is 73 rather than 3. README has the reasons with figures.

Cases: ids may be of any type that can be ordered; a null text counts as empty; a text shorter than a window keeps everything; rows equal
in id and text are one document and get equal results; rows of one id with different texts are ordered by the SHA-256 of the text; a
null id sorts first; a very long text is one chunk in one task; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix
from .repeats import Scheme, find_repeats, gram_hashes

PERIOD = 73
COVER = np.array(sorted({pow(2, k, PERIOD) for k in range(9)}), np.int64)  # the powers of 2 modulo 73: each difference occurs once
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


class Cover(Scheme):
    names_per_byte = len(COVER) / PERIOD

    def __init__(self, window: int = 100):
        if window <= PERIOD:
            raise ValueError(f"window must exceed {PERIOD}")
        self.window, self.gram = window, window - PERIOD + 1

    def symbols(self, data, bounds):
        return np.frombuffer(data, np.uint8), bounds

    def values(self, part):
        return _BYTE_VALUES[part]

    def names(self, symbols, bounds):
        sizes = np.diff(bounds)
        longest = int(sizes.max(initial=0))
        samples = (np.arange(longest // PERIOD + 1)[:, None] * PERIOD + COVER).reshape(-1)
        kept = np.where(sizes >= self.window, np.searchsorted(samples, sizes - self.gram, side="right"), 0)
        pos = np.concatenate([np.zeros(0, np.int64), *(samples[:k] + b for k, b in zip(kept.tolist(), bounds.tolist()) if k)])
        tags = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) % len(COVER) for k in kept.tolist() if k)])
        return pos, gram_hashes(self, symbols, pos, self.gram), tags

    def repeated(self, first, group, tags, total):
        # Suffixes in step share all samples of their common window, so a name held in one residue only is needed for one residue only.
        mixed = np.minimum.reduceat(tags, first) < np.maximum.reduceat(tags, first)
        return (total[group] > 1) & (mixed[group] | (tags == 0))

    def runs(self, c, pos, hashes):
        doc = np.searchsorted(c.bounds, pos, side="right") - 1
        at = np.maximum(c.bounds[doc], pos - PERIOD + 1)
        return np.arange(len(pos)), at, np.minimum(pos, c.bounds[doc + 1] - self.window) - at + 1

    def loads(self, c, at, n):
        return [c.data[a:b] for a, b in zip(at.tolist(), (at + n + self.window - 1).tolist())]

    def unpack(self, load):
        symbols = np.frombuffer(b"".join(load), np.uint8)
        return symbols, _BYTE_VALUES[symbols]


def suffix_dedup(df: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    nothing = hashlib.sha256(b"").hexdigest()

    def measure(text: bytes, gone: np.ndarray | None, several: bool) -> tuple:
        if gone is None:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return len(text), len(text) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()

    columns = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]
    rows, found = find_repeats(df, Cover(window), False, measure, columns, id_col, text_col)
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= window)  # all of a later copy starts earlier
    return rows.join(found, "digest").select(
        F.col("own_id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
