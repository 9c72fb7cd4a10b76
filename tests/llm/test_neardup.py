"""Near-dedup against all pairs."""

import random

import numpy as np
import pytest

from plumbline.llm import neardup
from plumbline.llm.graph import components

from . import brute


def results(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, **options).collect()}


def families(seed, n=150):
    """Chains and stars of variants, so that links and components differ."""
    rng = random.Random(seed)
    texts = []
    while len(texts) < n:
        if texts and rng.random() < 0.75:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = f"n{rng.randrange(999)}"
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        else:
            texts.append(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 2, 3, 4, 9, 40, 80]))))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,shingle,percent", [(1, 3, 85), (2, 5, 80)])
def test_like_all_pairs(documents, seed, shingle, percent):
    docs = families(seed)
    got = results(documents(docs), shingle=shingle, percent=percent)
    assert got == brute.near_duplicates(docs, shingle, percent)
    assert len({r[1] for r in got.values()}) < len(docs)


def test_edges(documents, cluttered, empty):
    same = "one two three four five six seven"
    rows = [(5, same), (3, same.upper()), (9, None), (8, ""), (7, " \n"), (6, "short"), (4, "Short"), (3, same), (None, same)]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(cluttered(documents(rows)), shingle=3, percent=85).collect() if r["doc_id"] is not None)
    assert got == [(False, 3, 5, 3, True), (False, 3, 5, 3, True), (False, 4, 1, 4, True), (False, 5, 5, 3, False), (False, 6, 1, 4, False), (False, 7, 0, 7, True), (False, 8, 0, 8, True), (False, 9, 0, 9, True)]
    null = [r for r in neardup.near_duplicates(documents(rows), shingle=3, percent=85).collect() if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in null] == [(None, True)]
    assert neardup.near_duplicates(empty).collect() == []


def test_any_id_and_ids_with_several_texts(spark):
    """A document known by two texts joins the groups of both, whatever the type of its id."""
    a, b, c = ("%s one two three four five six" % w for w in "abc")
    rows = [(1, a), (5, a), (5, b), (3, b), (8, c), (8, c), (9, None), (9, c), (None, a), (7, "alone it is")]
    want = {1: 1, 5: 1, 3: 1, 8: 8, 9: 8, None: None, 7: 7}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in got)
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 9) == [0, 5]
    named = [(f"x{i}" if i else None, t) for i, t in rows]
    got = neardup.near_duplicates(spark.createDataFrame(named, "doc_id string, text string"), shingle=3, percent=85).collect()
    assert all(r["component_id"] == (want[int(r["doc_id"][1:])] and f"x{want[int(r['doc_id'][1:])]}") for r in got if r["doc_id"])
    once = {r["doc_id"]: r["kept"] for r in neardup.near_duplicates(spark.createDataFrame([("u", a), ("t", a), ("v", b)], "doc_id string, text string"), shingle=3).collect()}
    assert once == {"t": True, "u": False, "v": True}


def test_hot_heads_are_split(documents, monkeypatch):
    monkeypatch.setattr(neardup, "SPOKES", 2)
    docs = families(5)
    assert results(documents(docs), shingle=3, percent=85) == brute.near_duplicates(docs, 3, 85)


def test_very_long_texts(documents):
    long = " ".join(f"w{k}" for k in range(60_000))
    got = results(documents([(1, long), (2, long + " end"), (3, long[: len(long) // 2])]), shingle=3, percent=85)
    assert [got[k][1] for k in (1, 2, 3)] == [1, 1, 3]


def test_tables_are_dropped(documents, tmp_path, spark, monkeypatch):
    """Only what the result reads stays in the shared folder."""
    monkeypatch.setattr("plumbline.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    out = neardup.near_duplicates(documents(families(3)), shingle=3, percent=85)
    assert out.count() and sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["known", "sketches"]


def test_densified_bins_come_from_full_ones():
    s = np.sort(np.random.default_rng(1).integers(0, 2**63, 3).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(neardup.signature(s), neardup.signature(s)) and len(set(neardup.signature(s).tolist())) > 3


def test_residual_join_is_exact(documents):
    docs = families(7)
    df = documents(docs)
    sets = {i: brute.shingles(t, 3) for i, t in docs}
    left, texts = df.selectExpr("doc_id rep", "doc_id component"), df.selectExpr("doc_id id", "text")
    got = {(r["u"], r["v"]) for r in neardup._confirm(neardup._residual_pairs(left, texts, 3, 85), texts, 3, 85).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert got == want and want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (205, 100), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 205: 100}
