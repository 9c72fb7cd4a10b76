"""Language identification, words first.

A known word adds its log frequency in each language. An unseen word is read through its character n-grams,
padded at both ends: at every place the longest n-gram that is known (4 characters down to 1), with the mean over
the places standing for the word. The score is the posterior of the best language, with the evidence of a long text
held to EVIDENCE words so that it stays a graded number. It compares the learned languages only; how much of a text
its language knows is the share named known.

Training takes a bounded sample of whole labelled documents of each language: each is taken by a hash of its id, at
the rate min(1, train_docs / documents, train_chars / characters), and the one with the least hash always is, so that no
language is lost. All words of the sample and all n-grams of these words make the model; nothing is cut from it. Its size is bounded
by the sample, languages times train_chars, so it can be broadcast.

Cases: a null text, or one without a letter (str.isalpha), is "und" with score 0; so is every text where nothing could be
learned; of languages with equal scores the first by name wins; a null id hashes as an empty text; repeated rows agree; a very
long text is read whole, its words beyond the memo one by one; an empty table gives an empty table; other columns pass by, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, col, judge_texts, map_rows, stash, whole_row

TRAIN_DOCS = 4000
TRAIN_CHARS = 6_000_000
EVIDENCE = 25
KNOWN_PRIOR = 2  # a text of a few unseen words tells little
LONGEST = 4
MEMO = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = _LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    # The pattern also takes numbers such as a superscript two or a Roman numeral sign, which are no letters.
    return [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split(" ") if w]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]  # word -> row of word_logs
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    floor: np.ndarray  # by language, the logarithm that a word has where it was not learned


def _logs(counts: Iterable[dict[str, int]], n_langs: int) -> tuple[dict[str, int], np.ndarray]:
    """From one language's counts after another: token -> row, and the logarithms of the smoothed shares."""
    index: dict[str, int] = {}
    held = []
    for own in counts:
        rows = np.fromiter((index.setdefault(token, len(index)) for token in own), np.int64, len(own))
        held.append((rows, np.fromiter(own.values(), np.float64, len(own))))
    table = np.zeros((len(index), n_langs))
    for lang, (rows, n) in enumerate(held):
        table[rows, lang] = n
    total = table.sum(axis=0) + 0.5 * max(1, len(index))
    return index, np.log((table + 0.5) / total)


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def build(rows: Iterable[tuple[str, str, int]]) -> Model:
    """From (lang, word, count) rows."""
    by: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, word, n in sorted(rows):  # so that the model does not depend on how rows were dealt
        by[lang][word] = n
    langs = sorted(by)

    def gram_counts(size: int) -> Iterator[Counter]:
        for lang in langs:
            own: Counter = Counter()
            for word, n in by[lang].items():
                for g in grams_of(word, size):
                    own[g] += n
            yield own

    index, logs = _logs((by[lang] for lang in langs), len(langs))
    grams: dict[str, int] = {}
    tables = []
    for size in range(1, LONGEST + 1):  # each length is a distribution of its own
        own, table = _logs(gram_counts(size), len(langs))
        before = sum(map(len, tables))
        grams |= {g: row + before for g, row in own.items()}
        tables.append(table)
    floor = np.log(0.5 / np.array([sum(by[lang].values()) + 0.5 * max(1, len(index)) for lang in langs]))
    return Model(langs, index, logs, grams, np.concatenate(tables), floor)


class Scorer:
    """Judges texts; unseen words are read once and kept in a memo of bounded size beside the model, which is not copied."""

    def __init__(self, model: Model):
        self.m = model
        self._fresh()

    def _fresh(self) -> None:
        self.memo: dict[str, int] = {}
        self.logs = np.zeros((MEMO, max(1, len(self.m.langs))))

    def backoff(self, word: str) -> np.ndarray:
        padded, grams = f"^{word}$", self.m.grams
        found = []
        for k in range(len(padded)):
            for n in range(LONGEST, 0, -1):
                row = grams.get(padded[k : k + n]) if k + n <= len(padded) else None
                if row is not None:
                    found.append(row)
                    break
        if not found:
            return np.zeros(len(self.m.langs))
        return self.m.gram_logs[found].mean(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str) -> tuple[str, float, float]:
        """Language, score, and the share of the words that were learned in this language (as if KNOWN_PRIOR more were)."""
        words = words_of(text)
        if not words or not self.m.langs:
            return "und", 0.0, 0.0
        if len(self.memo) + len(words) > MEMO:
            self._fresh()
        model, memo = self.m.words, self.memo
        known, unseen, total = [], [], np.zeros(len(self.m.langs))
        for w in words:
            row = model.get(w)
            if row is not None:
                known.append(row)
                continue
            row = memo.get(w)
            if row is None:
                logs = self.backoff(w)
                if len(memo) >= MEMO:  # a text with more unseen words than the memo holds
                    total += logs
                    continue
                row = memo[w] = len(memo)
                self.logs[row] = logs
            unseen.append(row)
        if known:
            total += self.m.word_logs[known].sum(axis=0)
        if unseen:
            total += self.logs[unseen].sum(axis=0)
        z = total * (min(len(words), EVIDENCE) / len(words))
        e = np.exp(z - z.max())
        best = int(z.argmax())
        held = int((self.m.word_logs[known, best] > self.m.floor[best] + 0.1).sum()) if known else 0
        return self.m.langs[best], float(e[best] / e.sum()), (held + KNOWN_PRIOR) / (len(words) + KNOWN_PRIOR)


def key_crc(df: DataFrame, id_col: str):
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")))


def _sample(df: DataFrame, folds: int, train_docs: int, train_chars: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang and text of the documents to learn from."""
    draw = F.pmod(F.xxhash64(F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit("langid")), F.lit(1_000_000)) / 1e6
    learn = df.filter(col(lang_col).isNotNull() & col(text_col).isNotNull() & (key_crc(df, id_col) % folds != 0))
    learn = learn.select(col(lang_col).alias("lang"), col(text_col).alias("text"), draw.alias("draw"))
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.min("draw").alias("least"))
    rate = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("docs"), F.lit(float(train_chars)) / F.greatest("chars", F.lit(1)))
    sizes = stash(sizes.select(F.col("lang").alias("of"), rate.alias("rate"), "least"), "languages")
    return learn.join(sizes, F.col("lang") == F.col("of")).filter((F.col("draw") < F.col("rate")) | (F.col("draw") == F.col("least"))).select("lang", "text")


def train(df: DataFrame, folds: int = 5, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from labelled documents outside fold 0."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), binary(batch, "text")):
            n.update((lang, w) for w in words_of(text.decode("utf-8", "replace")))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    sample = _sample(df, folds, train_docs, train_chars, id_col, text_col, lang_col)
    counts = map_rows(sample, fn, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    return build(zip(*(counts.column(c).to_pylist() for c in ("lang", "word", "n"))))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """id, lang_pred and score of every document, or with whole_rows its row (a struct), these two and known; labels are not read."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])

    def judge():
        scorer = Scorer(sent.value)
        return lambda t: ("und", 0.0, 0.0) if t is None else scorer.judge(t.decode("utf-8", "replace"))

    found = df.select(whole_row(df).alias("row"), judge_texts(df.sparkSession, col(text_col), judge, schema).alias("told"))
    if whole_rows:
        return found.select("row", "told.*")
    return found.select(F.col("row").getField(id_col).alias(id_col), "told.lang_pred", "told.score")
