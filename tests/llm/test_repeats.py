"""Suffix dedup and substring dedup against plain Python."""

import datetime
import random

import numpy as np
import pytest

from plumbline.llm import repeats, substrings, suffixes

from . import brute


def results(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def bytes_of(df, n=100):
    return results(suffixes.suffix_dedup(df, n), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def words_of(df, n=35):
    return results(substrings.substring_dedup(df, n), "n_words", "n_removed", "kept_sha256")


def test_cover_is_perfect():
    differences = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD)) and len(suffixes.COVER) * (len(suffixes.COVER) - 1) + 1 == suffixes.PERIOD


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_like_brute_force(documents, seed):
    docs = list(enumerate(brute.passages(seed)))
    got = bytes_of(documents(docs))
    assert got == brute.byte_repeats(docs, 100)
    assert sum(r[1] for r in got.values()) > 0


@pytest.mark.parametrize("seed", [3, 4])
def test_words_like_brute_force(documents, seed):
    docs = list(enumerate(brute.passages(seed)))
    got = words_of(documents(docs))
    assert got == brute.word_repeats(docs, 35)
    assert sum(r[1] for r in got.values()) > 0


def test_hot_names_are_salted(documents, monkeypatch):
    """With small limits every name is hot, chunks hold few texts, and windows meet in the second round."""
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 500)
    monkeypatch.setattr(repeats, "RESOLVE_ROWS", 2)
    docs = list(enumerate(brute.passages(5, 40)))
    assert bytes_of(documents(docs)) == brute.byte_repeats(docs, 100)
    assert words_of(documents(docs)) == brute.word_repeats(docs, 35)


@pytest.mark.parametrize("hot", [1, 1500])
def test_hashes_do_not_decide(documents, monkeypatch, hot):
    """With one hash for all windows, symbols alone tell them apart."""
    monkeypatch.setattr(repeats, "window_hash", lambda p, n: np.zeros(max(0, len(p) - n), np.uint64))
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = list(enumerate(brute.passages(6, 25)))
    assert bytes_of(documents(docs)) == brute.byte_repeats(docs, 100)
    assert words_of(documents(docs)) == brute.word_repeats(docs, 35)


def test_any_id(spark):
    long = " ".join(f"k{i}" for i in range(60))
    n = len(long)
    for kind, ids in (("string", ["b", "a", None, "c"]), ("long", [2, -(1 << 63), None, 3]), ("date", [datetime.date(2020, 1, 2), datetime.date(2020, 1, 1), None, datetime.date(2021, 1, 1)])):
        df = spark.createDataFrame([(i, t) for i, t in zip(ids, (long, long, "-" + long, "alone"))], f"doc_id {kind}, text string")
        got = {r["doc_id"]: r["n_removed"] for r in suffixes.suffix_dedup(df).collect()}
        assert got == {ids[0]: n, ids[1]: n, None: 0, ids[3]: 0}, kind  # the null id comes first
        got = {r["doc_id"]: r["n_removed"] for r in substrings.substring_dedup(df).collect()}
        assert got == {ids[0]: 60, ids[1]: 60, None: 59, ids[3]: 0}, kind


def test_tables_are_dropped(documents, tmp_path, monkeypatch):
    monkeypatch.setattr("plumbline.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    assert suffixes.suffix_dedup(documents(list(enumerate(brute.passages(7, 20))))).count() == 20
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["texts"]


@pytest.mark.parametrize("chunk", [300, 3000, 10**9])
def test_names_hot_in_few_or_many_chunks(documents, monkeypatch, chunk):
    """A passage in every document with different neighbours on both sides, and texts in periods, over few and many chunks."""
    rng = random.Random(chunk)
    monkeypatch.setattr(repeats, "HOT", 12)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(repeats, "RESOLVE_ROWS", 3)
    common = " ".join(f"c{k}" for k in range(22))
    sides = [" ".join(f"s{rng.randrange(3)}" for _ in range(20)) for _ in range(6)]
    docs = [(k, f"{rng.choice(sides)} {common} {rng.choice(sides)}") for k in range(40)] + [(50, "ab " * 200), (51, "ba " * 150), (52, f"{sides[0]} {common}")]
    assert bytes_of(documents(docs)) == brute.byte_repeats(docs, 100)
    assert words_of(documents(docs)) == brute.word_repeats(docs, 35)


def test_hash_segments(monkeypatch):
    monkeypatch.setattr(repeats, "_SEGMENT", 64)
    scheme = suffixes.Cover()
    symbols = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    pos = np.arange(len(symbols) - 28)
    h = repeats.gram_hashes(scheme, symbols, pos, 28)
    assert (h[256:] == h[:-256]).all() and len(set(h[:256].tolist())) == 256


def test_long_text(documents):
    base = " ".join(f"word{k}" for k in range(40_000))
    docs = [(1, base), (2, "start " + base[1000:]), (3, "x")]
    got = bytes_of(documents(docs))
    assert got[1][1] == 0 and got[2][1] == len(base) - 1000 or got[2][1] == len(base) - 999
    words = words_of(documents(docs))
    assert words[3][1] == 0 and words[2][1] >= 39_800


def test_ties_repeats_and_nulls(documents, cluttered, empty):
    long = "abcdefghij " * 5 + " ".join(f"k{i}" for i in range(40))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, ""), (3, long), (4, long + "!"), (4, long + "?")]
    got = [tuple(r) for r in suffixes.suffix_dedup(cluttered(documents(rows))).collect()]
    n = len(long)
    assert len(got) == len(rows)
    assert sorted(r[2] for r in got if r[0] is None) == [0, 0]  # the null id sorts first
    assert [r[2] for r in got if r[0] == 1] == [n, n] and [r[2] for r in got if r[0] == 3] == [n]
    assert sorted(r[2] for r in got if r[0] == 4) == [n, n]
    got = [tuple(r) for r in substrings.substring_dedup(cluttered(documents(rows))).collect()]
    words = len(long.split())
    assert len(got) == len(rows) and [r[2] for r in got if r[0] in (1, 3)] == [words] * 3
    only = [(7, long), (7, long)]  # one document twice repeats nothing
    assert [r["n_removed"] for r in substrings.substring_dedup(documents(only)).collect()] == [0, 0]
    assert [r["n_removed"] for r in suffixes.suffix_dedup(documents(only)).collect()] == [0, 0]
    assert suffixes.suffix_dedup(empty).collect() == [] and substrings.substring_dedup(empty).collect() == []


def test_window_bound():
    with pytest.raises(ValueError):
        suffixes.Cover(suffixes.PERIOD)
