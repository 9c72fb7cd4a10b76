"""Substring dedup by fixed-block anchors: words inside a window whose sequence also starts anywhere else.

Every document is cut into non-overlapping blocks of (window + 1) // 2 words from its start, which are indexed by hash;
any window holds one of its own document's blocks whole. Every rolling gram of that length probes the index, so two
equal windows always meet at the first one's block. A gram is an anchor if it is some document's block and occurs
twice or more, which its words alone decide. Hits are extended on words, to both sides of an anchor: the words that windows around it
can reach go to the least anchor inside each (the same for equal windows), where places with the same words are found by sorting and
checked word by word along the run; runs of repeated windows join up to the maximal exact repeats.

Cases: ids may be of any type; a null text has no words; a text of fewer words than a window keeps everything; rows equal in id and text
are one document and get equal results; rows of one id with different texts are two documents; a null id is an id like any other; a very
long text is one chunk in one task; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import numbered
from .repeats import Scheme, find_repeats, gram_hashes

WINDOW = 35
_NONE = np.uint64((1 << 64) - 1)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by running minima over blocks from both sides."""
    n = len(v) - w + 1
    blocks = np.concatenate([v, np.full(-len(v) % w, _NONE)]).reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count, joined."""
    row = np.repeat(np.arange(len(counts)), counts)
    return starts[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]


class Blocks(Scheme):
    names_per_byte = 1 / 6

    def __init__(self, window: int = WINDOW):
        self.window, self.gram = window, (window + 1) // 2
        self.reach = window - self.gram + 1  # grams inside a window

    def symbols(self, data, bounds):
        words = [data[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return numbered([w for ws in words for w in ws])[1], np.cumsum([0, *map(len, words)])

    def names(self, symbols, bounds):
        sizes = np.diff(bounds)
        counts = np.where(sizes >= self.window, sizes - self.gram + 1, 0)
        pos = _ranges(bounds[:-1], counts)
        tags = (_ranges(np.zeros(len(counts), np.int64), counts) % self.gram == 0).astype(np.int64)
        return pos, gram_hashes(self, symbols, pos, self.gram), tags

    def repeated(self, first, group, tags, total):
        indexed = np.maximum.reduceat(tags, first) == 1
        return (total[group] > 1) & indexed[group]

    def runs(self, c, pos, hashes):
        symbols, bounds = c.symbols, c.bounds
        sizes = np.diff(bounds)
        starts = _ranges(bounds[:-1], np.maximum(0, sizes - self.window + 1))
        none = np.zeros(0, np.int64)
        if not len(starts) or not len(pos):
            return none, none, none
        low = np.uint64((1 << 24) - 1)
        v = np.full(len(symbols), _NONE)
        # The place stands in the low bits, so that of equal hashes the leftmost is least; one segment holds 2**24 places.
        picked = np.full(len(starts), -1, np.int64)
        v[pos] = (hashes & ~low) | (pos & int(low)).astype(np.uint64)
        step = (1 << 24) - self.reach
        for a in range(0, len(symbols), step):
            lo, hi = np.searchsorted(starts, (a, a + step))
            if lo < hi:
                part = v[a : a + step + self.reach]
                if a:
                    held = part != _NONE
                    part = np.where(held, (part & ~low) | np.arange(len(part), dtype=np.uint64), _NONE)
                least = sliding_min(part, self.reach)[starts[lo:hi] - a]
                picked[lo:hi] = np.where(least != _NONE, (least & low).astype(np.int64) + a, -1)
        starts, picked = starts[picked >= 0], picked[picked >= 0]
        if not len(starts):
            return none, none, none
        first = np.flatnonzero((np.diff(picked, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        n = np.diff(np.append(first, len(starts)))
        return np.searchsorted(pos, picked[first]), starts[first], n

    def loads(self, c, at, n):
        words = [w for a, b in zip(c.byte_bounds[:-1].tolist(), c.byte_bounds[1:].tolist()) for w in c.data[a:b].split()] if len(at) else []
        return [b" ".join(words[a : a + k + self.window - 1]) for a, k in zip(at.tolist(), n.tolist())]

    def unpack(self, load):
        return numbered(b" ".join(load).split(b" ") if load else [])


def substring_dedup(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row."""
    nothing = hashlib.sha256(b"").hexdigest()

    def measure(text: bytes, gone: np.ndarray | None, several: bool) -> tuple:
        words = text.split()
        if several and len(words) >= window:  # a copy elsewhere repeats every window
            return len(words), len(words), nothing
        kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    columns = [("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")]
    rows, found = find_repeats(df, Blocks(window), True, measure, columns, id_col, text_col)
    return rows.join(found, "digest").select(F.col("own_id").alias(id_col), "n_words", "n_removed", "kept_sha256")
