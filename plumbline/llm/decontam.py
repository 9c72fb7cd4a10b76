"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (13 consecutive words, or all words of a shorter item) are wanted at full containment. A set's tokens are
ordered by rarity (occurrences over all documents), and the prefix that a similarity asks for has one token at full
containment: the rarest. Documents are joined with the windows on these tokens. The token's place in the window fixes where
the window would start, which the positional bound (not before the text's start) and the length bound (not past its end) must
allow, and the words from there are compared as a whole.

A document sends an occurrence of a token, with the words around it, only where it may count: two bitmaps of fixed size,
broadcast, tell which hashes are a window's token and which are a window (they let some pass that are neither, and stop none that
are). Neither the benchmark nor its vocabulary has to fit in a worker or the driver, and whole texts are never shuffled but
for the last join, where Spark broadcasts the table of hit texts if it is small. What is found belongs to a text, known by a
128-bit hash, so copies share it.

Cases: a null text has no words and is clean; an item without words has no window; repeated items count under each of their ids; an
item with a null id is listed as an empty text; repeated documents agree; of tokens equally rare in a window the first by its bytes,
then by place, is taken; a very long text is scanned in one task, its words as 64-bit hashes; empty tables are fine; other columns do
not matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, col, covered, drop, judge_texts, map_rows, mix, prefix_hash, slices, stash, whole_row, window_hash
from .neardup import word_hashes

WINDOW = 13
BITS = 1 << 23
ROWS_AT_ONCE = 20_000
_PAGE = 32_768  # bits of one of Spark's bitmaps
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _place(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64(salt)) & np.uint64(bits - 1)).astype(np.int64)


def _windows(items: DataFrame, n: int, bits: int) -> DataFrame:
    """A row for each window of each item: item, wid, window (words joined by a space), len and place (in a bitmap)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), binary(batch, "text")):
                words = words_of(text)
                size = min(n, len(words))
                places = _place(window_hash(prefix_hash(word_hashes(words)), size), size, bits) if words else []
                for a in range(0, len(places), ROWS_AT_ONCE):
                    rows = [b" ".join(words[k : k + size]) for k in range(a, min(a + ROWS_AT_ONCE, len(places)))]
                    columns = [pa.array([item] * len(rows), pa.string()), pa.array(map(xxhash.xxh3_128_digest, rows), pa.binary()), pa.array(rows, pa.binary()), pa.array([size] * len(rows), pa.int32()), pa.array(places[a : a + ROWS_AT_ONCE], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "wid", "window", "len", "place"])

    found = items.mapInArrow(run, "item string, wid binary, window binary, len int, place long")
    return found.withColumn("window", F.col("window").cast("string")).distinct()


def _bitmap(places: DataFrame, column: str, bits: int) -> Broadcast:
    """A broadcast boolean table of the places that occur; Spark builds it in pages, and all of them have bits / 8 bytes."""
    pages = places.groupBy(F.floor(F.col(column) / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col(column) % _PAGE).alias("bits")).collect()
    held = np.zeros(bits // 8, np.uint8)
    for r in pages:
        held[r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return places.sparkSession.sparkContext.broadcast(held)


def _table(sent: Broadcast) -> np.ndarray:
    return np.unpackbits(sent.value, bitorder="little").view(bool)


def _with_places(words: DataFrame, bits: int) -> DataFrame:
    """word and place of a table of words."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = binary(batch, "word")
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(_place(word_hashes(words), 0, bits), pa.int64())], ["word", "place"])

    return map_rows(words.select("word"), fn, "word binary, place long").withColumn("word", F.col("word").cast("string"))


def _counts(texts: DataFrame, vocabulary: DataFrame, bits: int) -> DataFrame:
    """word and n, its occurrences over all documents, for words of the vocabulary that occur (and some others)."""
    sent = _bitmap(_with_places(vocabulary, bits), "place", bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _table(sent)
        for batch in (part for whole in batches for part in slices(whole)):
            n: Counter = Counter()
            for t in binary(batch, "text"):
                words = words_of(t)
                if words:
                    held = np.flatnonzero(wanted[_place(word_hashes(words), 0, bits)])
                    n.update(map(words.__getitem__, held.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    found = texts.mapInArrow(run, "word binary, n long")
    return found.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _occurrences(texts: DataFrame, tokens: Broadcast, windows: Broadcast, lengths: list[int], bits: int) -> DataFrame:
    """Occurrences of tokens inside what may be windows: token, key (of the text), pos, n_words, first (place of around) and around."""
    import xxhash

    reach = max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_token, is_window = _table(tokens), _table(windows)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text in binary(batch, "text"):
                words = words_of(text)
                if not words:
                    continue
                hashes = word_hashes(words)
                here = is_token[_place(hashes, 0, bits)]
                if not here.any():
                    continue
                prefix, inside = prefix_hash(hashes), np.zeros(len(words), bool)
                for size in lengths:
                    starts = np.flatnonzero(is_window[_place(window_hash(prefix, size), size, bits)])
                    if len(starts):
                        inside |= covered(starts, size, len(words))
                key = xxhash.xxh3_128_digest(text)
                for pos in np.flatnonzero(here & inside).tolist():
                    a = max(0, pos - reach + 1)
                    rows.append((words[pos], key, pos, len(words), a, b" ".join(words[a : pos + reach])))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["token", "key", "pos", "n_words", "first", "around"])

    found = texts.mapInArrow(run, "token binary, key binary, pos long, n_words long, first long, around binary")
    return found.withColumn("token", F.col("token").cast("string")).withColumn("around", F.col("around").cast("string"))


def _covered_words(spans: Column) -> Column:
    """Words inside any of the (start, len) spans, which come sorted."""
    seen = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    end = lambda x: x["start"] + x["len"]
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), end(x) - F.greatest(s["end"], x["start"]))).alias("n"), F.greatest(s["end"], end(x)).alias("end"))
    return F.aggregate(spans, seen, step, lambda s: s["n"])


def _hits(texts: DataFrame, items: DataFrame, n: int, bits: int) -> DataFrame:
    """key, n_hit, n_items and item_list of every text that holds a window."""
    windows = stash(_windows(items, n, bits), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # n of them at most
    empty = "key binary, n_hit long, n_items long, item_list string"
    if not lengths:
        return texts.sparkSession.createDataFrame([], empty)
    each = windows.select("wid", "len", "window").distinct().select("wid", "len", "window", F.posexplode(F.split("window", " ")).alias("at", "word"))
    counts = stash(_counts(texts, each.select("word").distinct(), bits), "rarity")
    ranked = each.join(counts, "word", "left").groupBy("wid", "len", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("rarest"))
    prefixes = stash(ranked.select(F.col("rarest.word").alias("token"), F.col("rarest.at").cast("long").alias("at"), "wid", "len", "window"), "prefixes")
    drop(counts)
    tokens = _bitmap(_with_places(prefixes.select(F.col("token").alias("word")).distinct(), bits), "place", bits)
    seen = stash(_occurrences(texts, tokens, _bitmap(windows, "place", bits), lengths, bits), "occurrences")
    start = F.col("pos") - F.col("at")
    bounded = seen.join(prefixes, "token").filter((start >= 0) & (start + F.col("len") <= F.col("n_words")) & (start >= F.col("first")))
    same = F.array_join(F.slice(F.split("around", " "), (start - F.col("first") + 1).cast("int"), F.col("len")), " ") == F.col("window")
    found = stash(bounded.filter(same).select("key", start.alias("start"), "len", "wid").distinct(), "found")
    drop(seen)
    drop(prefixes)
    spans = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    named = found.select("key", "wid").distinct().join(windows.select("wid", "item"), "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = spans.join(named, "key").select("key", _covered_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("item_list"))
    out = stash(both, "hits")
    drop(found)
    drop(windows)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, whole_rows: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row a document: id (with whole_rows its row, a struct), n_words, n_hit, n_items, items_sha256 and contaminated."""
    import xxhash

    if bits % _PAGE or bits & (bits - 1):
        raise ValueError(f"bits must be a power of two, {_PAGE} at least")
    items = benchmark.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), col(item_text_col).alias("text"))
    hits = _hits(docs.select(col(text_col).alias("text")), items.filter("text is not null"), n, bits)

    def judge():
        return lambda t: (len(words_of(t)), xxhash.xxh3_128_digest(t) if t else None)

    told = judge_texts(docs.sparkSession, col(text_col), judge, T.StructType([T.StructField("n_words", T.LongType()), T.StructField("key", T.BinaryType())]))
    row = (whole_row(docs) if whole_rows else F.struct(col(id_col))).alias("row")
    judged = docs.select(row, told.alias("told")).select("row", "told.n_words", F.col("told.key").alias("own_key"))
    all_ = judged.join(hits, F.col("own_key") == F.col("key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    head = F.col("row") if whole_rows else F.col("row").getField(id_col).alias(id_col)
    return all_.select(head, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("item_list", F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
