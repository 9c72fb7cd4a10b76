"""Token counts, exact, with bounded memory for documents of any length.

A document longer than one chunk (chunk characters) is encoded by the library in overlapping chunks, and each two are
spliced where a pre-token starts at the same place in both, far enough from either edge for no look-ahead and no special
string to reach across it. From such a place both encodings go on as that of the whole text would. With no such place the
overlap is doubled; when it reaches back to the last proven place, the text from there is encoded again at twice the
length, so the work stays within a constant times the text's length. A document of one chunk has nothing to splice;
a byte-level pre-tokeniser always breaks before a space that a non-space follows, so its space-led pieces are
independent, and the library's count of each distinct piece is kept in a bounded memo.

Only tokenisers with a byte-level pre-tokeniser without prefix space and normaliser get either way; any other is
given whole texts.

Cases: a null text counts as empty (0 bytes, 0 tokens); a text without any stable place is at last encoded whole; repeated
rows agree; an empty table gives an empty table; other columns pass by, whatever their names.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, col, map_rows

CHUNK_CHARS = 8192
OVERLAP_CHARS = 128
MEMO = 800_000

_INSIDE_RUN = re.compile(r"\s \s|\s \Z")  # a split before every space would cut a run of blanks
_SAFE = re.compile(r"(?= (?=\S))")


class Counter:
    """Counts tokens as one tokenizers file gives them."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.chunk, self.overlap = chunk, overlap
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word") or " " in a["content"]) for a in added)
        self.independent = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and not spec.get("normalizer") and plain
        self.margin = max([8, *(len(a["content"]) + 1 for a in added)])
        self.special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.memo: dict[str, int] = {}
        self.chunks = self.widened = 0

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if _INSIDE_RUN.search(text):
            return [p for p in _SAFE.split(text) if p]
        head, *rest = text.split(" ")
        return ([head] if head else []) + [" " + p for p in rest]

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens of each text, and in how many chunks it was encoded (0: one piece or more, none of them spliced)."""
        if not self.independent:
            return self._lengths(texts), [0] * len(texts)
        split = [None if len(t) > self.chunk else self._pieces(t) for t in texts]
        unseen = list({p for ps in split if ps for p in ps if p not in self.memo})
        if len(self.memo) + len(unseen) > MEMO:
            self.memo.clear()
            unseen = list({p for ps in split if ps for p in ps})
        self.memo.update(zip(unseen, self._lengths(unseen)))
        get = self.memo.__getitem__
        out, chunks = [], []
        for t, ps in zip(texts, split):
            before = self.chunks
            out.append(self.spliced(t) if ps is None else sum(map(get, ps)))
            chunks.append(self.chunks - before)
        if len(self.memo) > MEMO:
            self.memo.clear()
        return out, chunks

    def _encode(self, text: str) -> tuple[list[str], list[int | None]]:
        self.chunks += 1
        enc = self.tok.encode(text, add_special_tokens=False)
        return enc.tokens, enc.word_ids

    def _bytes(self, token: str) -> int:
        # The library trims leading blanks off the offsets of a token, so places come from the tokens' byte lengths.
        return len(token.encode()) if token in self.special else len(token)

    def _starts(self, text: str, tokens: list[str], words: list[int | None], reach: int) -> dict[int, int]:
        """Offset of each pre-token that starts in the first reach characters -> tokens before it."""
        place, at, last = _places(text[:reach]), 0, None
        out = {}
        for k, (token, word) in enumerate(zip(tokens, words)):
            if word is None or word != last:
                if at not in place:
                    break
                out[place[at]] = k
            last, at = word, at + self._bytes(token)
        return out

    def _ends(self, text: str, tokens: list[str], words: list[int | None], reach: int) -> dict[int, int]:
        """The same for the last reach characters."""
        first = max(0, len(text) - reach)
        tail = text[first:]
        place, at = _places(tail), len(tail.encode("utf-8", "surrogatepass"))
        out = {len(text): len(tokens)}
        for k in range(len(tokens) - 1, -1, -1):
            at -= self._bytes(tokens[k])
            if at < 0:
                break
            if at in place and (k == 0 or words[k] is None or words[k] != words[k - 1]):
                out[place[at] + first] = k
        return out

    def spliced(self, text: str) -> int:
        """The count of a text of several chunks."""
        start, total = 0, 0  # total: tokens before start, which is a boundary of the whole text
        base, end = 0, min(len(text), self.chunk)
        skip, left = 0, self._encode(text[:end])  # skip: tokens of left before start
        while end < len(text):
            overlap = self.overlap
            while True:
                b = end - overlap
                if b <= start:  # no stable place since start, from where any encoding agrees with the whole text's
                    end, base, skip = min(len(text), start + 2 * (end - start)), start, 0
                    left = self._encode(text[base:end])
                    break
                e = min(len(text), end + self.chunk)
                right = self._encode(text[b:e])
                before = self._ends(text[base:end], *left, overlap)
                after = self._starts(text[b:e], *right, overlap)
                common = [p for p in after if self.margin <= p <= overlap - self.margin and p + b - base in before]
                if common:
                    at = max(common)
                    total += before[at + b - base] - skip
                    start, base, end, left, skip = at + b, b, e, right, after[at]
                    break
                overlap *= 2
                self.widened += 1
        return total + len(left[0]) - skip


def _places(text: str) -> dict[int, int]:
    """Byte offset -> offset of each character and of the end."""
    if text.isascii():
        return dict(zip(range(len(text) + 1), range(len(text) + 1)))
    out, at = {}, 0
    for k, ch in enumerate(text):
        out[at] = k
        at += len(ch.encode("utf-8", "surrogatepass"))
    out[at] = len(text)
    return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) and n_chunks (encoded; 0: not spliced) of every document.

    tokenizer is the name of a public tokenizer file, looked up where the work runs.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        import public_tokenizers

        raw = [t or b"" for t in binary(batch, "text")]
        n, chunks = counter(public_tokenizers.path(tokenizer)).count([t.decode("utf-8", "replace") for t in raw])
        longs = [pa.array(x, pa.int64()) for x in (map(len, raw), n, chunks)]
        return pa.RecordBatch.from_arrays([batch.column("id"), *longs], ["id", "n_bytes", "n_tokens", "n_chunks"])

    m = map_rows(df.select(col(id_col).alias("id"), col(text_col).alias("text")), fn, f"id {id_type}, n_bytes long, n_tokens long, n_chunks long")
    return m.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
